"""Jobs for code-review outcome data, written as Spark DataFrame plans."""
