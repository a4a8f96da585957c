"""Part of svgloom, a PySpark-native engine for vector-graphics datasets."""
