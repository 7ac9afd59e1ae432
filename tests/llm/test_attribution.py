import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barloom.llm import attribution
from barloom.llm.queries import op3_offset_attribution

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def brute(text, bounds, rule):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    raw, spans, at, places = text.encode(), [], 0, byte_starts(text)
    letters = {c: b for b, c in __import__("barloom.llm.bpe", fromlist=["x"]).byte_letters().items()}
    for token in t.encode(text, add_special_tokens=False).tokens:
        end = at + len(token)
        assert bytes(letters[c] for c in token) == raw[at:end]
        chars = [i for i, (a, b) in enumerate(zip(places, places[1:])) if a < end and b > at]
        spans.append((chars[0], chars[-1] + 1))
        at = end
    out = [0.0] * len(bounds)
    for s, e in spans:
        shares = [max(0, min(e, b) - max(s, a)) for a, b in bounds]
        if not any(shares):
            continue
        if rule == "split":
            out = [o + x / (e - s) for o, x in zip(out, shares)]
        elif rule == "largest":
            out[shares.index(max(shares))] += 1
        else:
            spot = s if rule == "start" else e - 1
            for i, (a, b) in enumerate(bounds):
                if a <= spot < b:
                    out[i] += 1
    return out, len(spans)


def byte_starts(text):
    out = [0]
    for c in text:
        out.append(out[-1] + len(c.encode()))
    return out


TEXTS = ["Hello big world\n\n\nand  more\r\n lines \n", "é漢字\U0001f600 mixed\n\U0001f600\n漢", "", None, "\n", "no break", "a\n" * 50]


@pytest.mark.parametrize("rule", attribution.RULES)
def test_lines_and_structs(spark, rule):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, section string")
    cut = F.array(F.struct(F.lit(1).alias("begin"), F.lit(3).alias("stop")), F.struct(F.lit(3).alias("begin"), F.lit(7).alias("stop")), F.struct(F.lit(9).alias("begin"), F.lit(11).alias("stop")))
    for sections in (attribution.line_sections(), cut):
        got = {}
        for r in attribution.attribute(docs, PATH, public_tokenizers.PATTERN, sections, rule).orderBy("doc_id", "section").collect():
            got.setdefault(r.doc_id, []).append(r)
        for i, t in enumerate(TEXTS):
            rows = got[i]
            want, n = brute(t or "", [(r.begin, r.stop) for r in rows], rule)
            assert [round(r.n_tokens, 9) for r in rows] == [round(x, 9) for x in want], (i, t)
            assert rows[0].doc_tokens == n
            if rule == "split" or rule == "largest":
                assert rows[0].outside + sum(want) <= n + 1e-9


def test_query_adds_up(spark):
    rows = op3_offset_attribution(spark, "/root/testdata/sf0.001").groupBy("doc_id", "doc_tokens").agg(F.sum("n_tokens").alias("n")).collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert all(r.n == r.doc_tokens for r in rows)


def test_empty_table_and_rule(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert attribution.attribute(docs, PATH, public_tokenizers.PATTERN, attribution.line_sections()).count() == 0
    with pytest.raises(ValueError):
        attribution.attribute(docs, PATH, public_tokenizers.PATTERN, attribution.line_sections(), "other")
