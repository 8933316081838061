"""levelling -- survey-point height comparison as Spark DataFrame jobs.

Main entry points:

* ``levelling.sources.delimited.read_points / read_scope`` -- text and .xlsx inputs
* ``levelling.plans.pipelines.compare`` -- modes 1-3 (reference file and/or terrain heights)
* ``levelling.plans.pipelines.enrich_heights / grid_heights / thin_accurate`` -- modes 4, 5, thinning
* ``levelling.operators.pairing.nearest_pair / mutual_pairs`` -- nearest-point pairing
* ``levelling.functions.projection.project_2000_to_1992`` -- PL-2000 to PL-1992
* ``levelling.sinks.writers`` -- CSV and Parquet outputs
* ``levelling.streaming.compare`` -- the same work on streaming inputs
* ``python -m levelling.cli`` -- the five modes from the command line
"""

__version__ = "0.1.0"
