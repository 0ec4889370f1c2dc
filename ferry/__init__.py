"""ferry: file conversion and analytics jobs as plain Spark DataFrame jobs.

Discover files, read any supported format, project / dedupe / run SQL over an
``input_data`` view, reshape records, then write per file, merged, or cut into
fixed-size chunks, or deliver the chunks to an HTTP endpoint.
"""

from ferry.session import get_session, job_session, scratch_path
from ferry.plans.job import Job, JobError
from ferry.plans.runner import run, explain_job
from ferry.sources.catalogue import find_input_files
from ferry.sources.readers import ReadOptions, read_files
from ferry.operators.rowindex import with_row_index
from ferry.operators.chunking import add_chunks, chunk_manifest
from ferry.streaming.delivery import DeliveryConfig, deliver

__all__ = [
    "get_session",
    "job_session",
    "scratch_path",
    "Job",
    "JobError",
    "run",
    "explain_job",
    "find_input_files",
    "ReadOptions",
    "read_files",
    "with_row_index",
    "add_chunks",
    "chunk_manifest",
    "DeliveryConfig",
    "deliver",
]
