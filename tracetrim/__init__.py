"""tracetrim: a Spark-native toolkit for building and judging shorter reasoning traces.

Everything is DataFrame -> DataFrame or Column -> Column, so the same code runs in
batch jobs and in Structured Streaming.  Sub-packages:

* ``functions``  Column expressions (strip, word count, segmentation, reply parsing, answers)
* ``sources``    loaders, benchmark registry, curated rows, derived views, dataset I/O
* ``operators``  formatting, auditing, transitions, rollouts, evaluation, reports
* ``plans``      the registered queries and their SQL equivalents
* ``streaming``  incremental (file-source) build of transitions
"""

from tracetrim.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
