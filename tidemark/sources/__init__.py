from tidemark.sources.tables import closable_stream, delay_for_all, stream, survey, table
from tidemark.sources.partitioned import read_partitions, write_partitioned

__all__ = ["closable_stream", "delay_for_all", "read_partitions", "stream", "survey", "table", "write_partitioned"]
