"""Daily product-store demand analytics as Spark DataFrame operators."""
