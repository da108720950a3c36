"""gridloom: voxel, object-table and training-data analytics as PySpark plans."""

__version__ = "0.1.0"
