"""folio: a PySpark-native engine that turns books and other long documents into structured text."""

__version__ = "0.1.0"
