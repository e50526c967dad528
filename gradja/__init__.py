"""gradja: corpus building, labelling and evaluation as Spark DataFrame plans."""
