"""Formula languages of semantic models: measures and workbook fields, compiled to Spark columns."""
