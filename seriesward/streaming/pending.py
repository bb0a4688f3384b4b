"""Rows of a series that wait for the watermark, as Arrow blocks in state: one state entry per arriving batch instead of one
per row, and columns instead of Python objects in the task that settles them."""

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.pandas.types import to_arrow_schema

STATE = "block binary"
ROWS = 10_000  # rows that a task turns into Python objects at a time


class Pending:
    def __init__(self, handle, schema, order: tuple):
        self.blocks, self.schema, self.order = handle.getListState("pending", STATE), to_arrow_schema(schema), order

    def add(self, pdf) -> None:
        columns = [pa.Array.from_pandas(pdf[f.name], type=f.type) for f in self.schema]
        self.blocks.appendValue((_packed(pa.Table.from_arrays(columns, schema=self.schema)),))

    def settle(self, watermark_ms: int) -> tuple:
        """Takes the rows that the watermark has passed, in order; also gives the first time that still waits, if any."""
        blocks = [pa.ipc.open_stream(bytes(b[0])).read_all() for b in self.blocks.get()]
        rows = pa.concat_tables(blocks) if blocks else self.schema.empty_table()
        passed = pc.fill_null(pc.less_equal(rows["at"], watermark_ms * 1000), False)
        due, waiting = rows.filter(passed), rows.filter(pc.invert(passed))
        del blocks, rows, passed  # a long series is held once while it is sorted
        if len(due):
            if len(waiting):
                self.blocks.put([(_packed(waiting),)])
            else:
                self.blocks.clear()
        due = due.take(pc.sort_indices(due, sort_keys=[(c, "ascending") for c in self.order])).combine_chunks()
        return due, pc.min(waiting["at"]).as_py()


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def slices(table: pa.Table):
    """A table in slices of bounded size."""
    return (table.slice(i, ROWS) for i in range(0, len(table), ROWS))
