"""Structured Streaming: incremental declaration ingest.

The reference has no streams, windows or event time; its only arriving
data is declaration files.  ``declaration_stream`` runs the batch ingest
(``salarium.sources.ingest``) on each micro-batch of new files.
"""

from salarium.streaming.ingest_stream import declaration_stream, load_audit, load_ingested

__all__ = ["declaration_stream", "load_audit", "load_ingested"]
