"""Market-evidence and price-bar research operators written as Spark DataFrame plans."""
