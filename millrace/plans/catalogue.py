"""Every query of the core by name, with the SQL it is held against."""

from __future__ import annotations

from . import corpus, logs, storage, training

flagship = corpus.flagship
QUERIES = {**corpus.QUERIES, **logs.QUERIES, **training.QUERIES, **storage.QUERIES}
SQL = {**corpus.SQL, **logs.SQL, **training.SQL, **storage.SQL}
