"""All queries of the library with the SQL that gives the same rows."""

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with DuckDB SQL for the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


from . import corpus, evaluation, files, filters, loading, metrics, notes, rolls, samples, scores, sequences, tasks, telemetry  # noqa: E402, F401
