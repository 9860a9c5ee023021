"""matstream: principal component analysis over numeric Spark tables and streams.

A table of numeric rows is a matrix in *rows form* (``row_id BIGINT, features
ARRAY<DOUBLE>``) or *cells form* (``row_id BIGINT, j INT, v DOUBLE``).  The
building blocks are ordinary DataFrame functions; the sliding-window PCA in
:mod:`matstream.plans.sliding` is composed from them.
"""

from matstream.sources.frames import from_array, from_columns, read_dense_csv, parse_dense_lines
from matstream.operators.rowid import with_row_id, first_block, first_rows, rows_at
from matstream.operators.windows import window_schedule, schedule_frame, slide, expand_windows
from matstream.plans.sketch import sketch_svd, residual_norm, relative_error
from matstream.plans.sliding import sliding_pca, sliding_pca_by_key, window_spectral_error

__all__ = [
    "from_array", "from_columns", "read_dense_csv", "parse_dense_lines",
    "with_row_id", "first_block", "first_rows", "rows_at",
    "window_schedule", "schedule_frame", "slide", "expand_windows",
    "sketch_svd", "residual_norm", "relative_error",
    "sliding_pca", "sliding_pca_by_key", "window_spectral_error",
]
