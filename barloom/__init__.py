"""Bar-flow analytics on Spark: bars, volatility, flow features, fits, forecasts and event studies."""
