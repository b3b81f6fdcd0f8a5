"""corpusloom: corpus-building and task/queue analytics as Spark DataFrame jobs.

Every operator is a plain function ``DataFrame -> DataFrame`` (use it with
``df.transform``); rules, lexicons, templates and queue settings are data
(see :mod:`corpusloom.rules`) so they can be swapped or broadcast.
"""

from corpusloom.session import get_spark, checkpoint_dir, read_table

__all__ = ["get_spark", "checkpoint_dir", "read_table"]
