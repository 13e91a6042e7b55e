"""dataclinic: data-repair and trajectory analytics on Spark DataFrames.

Modules (all functions take and return DataFrames and stay lazy):

* ``dataclinic.operators.profile``   column profile, missing, duplicates, class balance
* ``dataclinic.operators.recommend`` / ``diagnose``  ranked repair proposals, analyst plan
* ``dataclinic.operators.repair`` / ``versions``     repairs and a bounded undo stack
* ``dataclinic.operators.validate`` / ``drift`` / ``quality`` / ``integrity``
* ``dataclinic.operators.evaluate``  MLlib RF / LR on an exact stratified holdout
* ``dataclinic.operators.inject``    reproducible faults for testing
* ``dataclinic.operators.traj`` / ``score`` / ``audit``  trajectory parsing, rubrics, policy audit
* ``dataclinic.operators.runlogs`` / ``curriculum`` / ``metrics``  run-log analytics
* ``dataclinic.operators.examples``  prompt / response tables
* ``dataclinic.sources``             driver tables, fixtures, JSON-lines logs
* ``dataclinic.streaming``           Structured Streaming forms
"""

__version__ = "0.1.0"
