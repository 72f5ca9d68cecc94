"""casewise: case-retrieval and fact-rollup analytics written as PySpark DataFrame plans."""
