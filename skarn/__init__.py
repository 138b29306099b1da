"""skarn: DataFrame-first operators for turning packed assets and loose web
sources into clean, published reference tables."""
