"""trackwise: a PySpark-native engine for inspection-image metadata, masks, features and text corpora."""
