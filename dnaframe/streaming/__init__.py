from dnaframe.streaming.ingest import class_totals, load_streamed, start_ingest, stream_delimited

__all__ = ["class_totals", "load_streamed", "start_ingest", "stream_delimited"]
