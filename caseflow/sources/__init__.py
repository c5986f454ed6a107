from caseflow.sources.readers import detect_format, read_csv_log, read_parquet_log, read_xes_log, read_log  # noqa: F401
from caseflow.sources.aggregated import aggregated_to_events  # noqa: F401
from caseflow.sources import testlogs  # noqa: F401
