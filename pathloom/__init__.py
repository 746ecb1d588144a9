"""pathloom: accessibility-aware graph analytics and text pipelines on PySpark."""
