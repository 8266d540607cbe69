"""weftline: declarative source-to-target mappings compiled to Spark DataFrame plans."""
