"""paperloom: an analytics engine for papers, forms and text corpora on PySpark."""
