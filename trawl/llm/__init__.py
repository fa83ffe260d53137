"""Training-data operators: packing, deduplication, decontamination, search, classifiers and filters.

Each module holds one operator with a general interface (DataFrame in, DataFrame out);
``queries`` wires them to the driver's tables.  Nothing outside this subpackage imports it.
"""
