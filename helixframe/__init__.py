"""helixframe: a PySpark-native engine for personal-variant data and the literature around it."""
