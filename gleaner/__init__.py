"""gleaner: review mining and topic evaluation as Spark DataFrame jobs.

Every public operator takes and returns a ``pyspark.sql.DataFrame``; column
names are parameters.  Sub-packages:

* ``functions`` - column expressions (text normalisation, tokenising,
  segmentation, vector math) and fixed word lists.
* ``sources``   - readers and writers (CSV, JSON lines, Parquet vectors,
  topic text files, topic-word JSON).
* ``operators`` - DataFrame -> DataFrame operators (dedup, segmentation,
  c-TF-IDF, coherence, diversity, clusters, representatives, topic tables,
  embeddings, dimension reduction, density clusters).
* ``plans``     - the query catalogue over the test tables.
* ``streaming`` - the stateless operators applied to streaming DataFrames.
"""

from gleaner.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
