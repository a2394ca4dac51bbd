"""Small helpers shared by the operators."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F


def load(spark, folder, table):
    return spark.read.parquet(f"{folder}/{table}.parquet")


def with_text(df, *columns):
    """The named columns, so that extra columns of any name take no part."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def fresh(df, *names):
    """``names``, underlined until ``df`` has no column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def sorted_groups(batches, keys):
    """Rows of each key from Arrow batches sorted by ``keys``, as one table per key.

    Memory is one group and one batch, so callers cut their groups to a bounded size first.
    """
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)
