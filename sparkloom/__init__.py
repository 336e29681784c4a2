"""sparkloom: a PySpark-native engine for building and auditing text-training corpora."""

__version__ = "0.1.0"
