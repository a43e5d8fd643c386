"""assaykit: a PySpark-native toolkit for labelled experimental data.

Ingest messy wide tables (entities x test conditions), clean and label them,
unpivot to one row per (entity, condition), derive sequence descriptors as
native column expressions, report QC tables, build deterministic splits,
train reference classifiers with ``pyspark.ml``, compute metrics as
DataFrame aggregates and audit a release.

Public surface: ``Column -> Column`` functions in :mod:`assaykit.functions`
and ``DataFrame -> DataFrame`` operators in :mod:`assaykit.operators`.
"""

__version__ = "0.1.0"
