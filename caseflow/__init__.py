"""caseflow: predictive process monitoring on event logs, built on Spark DataFrames.

Every operator is a function ``DataFrame -> DataFrame`` (or an ML Estimator/Model
pair where something is fitted).  Canonical event-log columns are ``case_id``,
``activity``, ``timestamp`` and ``_event_index``; everything else passes through as
an attribute.
"""

from caseflow.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
__version__ = "0.1.0"
