"""Pages of a stored index: the posting lists of many terms as one value, and the Python functions over batches that make and read them.

A page has the lists of one (corpus, kind, block) from one stretch of texts, as an Arrow stream of ``term, df, rows, tfs``, and beside it the
stream ``row_id, len`` of its rows, by whose places the lists name them. A vocabulary is mostly of terms that are met once, so a line per term, or per posting, would be most of
the work of an index: pages are what is shuffled, sorted and written, and numbers are summed over arrays within them.

The functions are closures, so workers need not find this library.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

#: Bytes of text, and number of texts, whose terms are put together at a time.
GATHERED_BYTES = 8_000_000
GATHERED_ROWS = 50_000

PAGES = "corpus string, kind string, block int, page binary, page_rows binary"

Batches = Iterator[pa.RecordBatch]


def block_of(blocks: Column | int) -> Column:
    """Block of a term in its corpus: neither a corpus nor a term with most of the postings is one block."""
    part = [F.crc32(F.coalesce(F.col(c), F.lit(""))) for c in ("corpus", "term")]
    return F.pmod(part[0] + part[1], F.lit(blocks)).cast("int")


def functions(row_id: pa.DataType, blocks: int, kinds: tuple[str, str, str], gathered_bytes: int = GATHERED_BYTES) -> SimpleNamespace:
    """Functions for ``mapInArrow``. ``kinds`` names those of white-space pieces, words and marks."""
    inside = pa.schema([("term", pa.string()), ("df", pa.int32()), ("rows", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])
    inside_rows = pa.schema([("row_id", row_id), ("len", pa.int64())])
    lists_schema = pa.schema([("term", pa.string()), ("df", pa.int32()), ("row_ids", pa.list_(row_id)), ("counts", pa.list_(pa.int64()))])
    outside = pa.schema([("corpus", pa.string()), ("kind", pa.string()), ("block", pa.int32()), ("page", pa.binary()), ("page_rows", pa.binary())])
    opened_schema = pa.schema([("corpus", pa.string()), ("kind", pa.string()), *lists_schema])
    word = re.compile(r"\w{2,}")

    def column(table: pa.Table, name: str) -> pa.Array:
        return pa.concat_arrays(table.column(name).chunks) if table.num_rows else pa.array([], table.schema.field(name).type)

    def numbered(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
        coded = values.dictionary_encode(null_encoding="encode")
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary

    def changes(*numbers: np.ndarray) -> np.ndarray:
        """Where a line differs from the one before."""
        new = np.zeros(len(numbers[0]), bool)
        new[:1] = True
        for n in numbers:
            new[1:] |= n[1:] != n[:-1]
        return new

    def sums(texts: pa.Array) -> np.ndarray:
        return np.array([zlib.crc32(t.encode()) if t else 0 for t in texts.to_pylist()], np.int64)

    def written(lists: pa.RecordBatch) -> bytes:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, lists.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_batch(lists)
        return out.getvalue().to_pybytes()

    def read(page: bytes, *names: int) -> pa.Table:
        options = pa.ipc.IpcReadOptions(included_fields=[*names], use_threads=False)
        return pa.ipc.open_stream(page, options=options).read_all()

    def page_lists(page: bytes, page_rows: bytes, wanted: pa.Array | None) -> pa.Table:
        """The lists of a page, of all terms or of those wanted, with ids and counts; a count is tf and len in one number."""
        lists = read(page, 0, 1, 2, 3)
        if wanted is not None:
            lists = lists.filter(pc.is_in(lists.column(0), wanted))
        rows, of = read(page_rows, 0, 1), column(lists, "rows")
        ends, place = pa.array(np.append(0, np.cumsum(of.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int32)), of.flatten()
        size = column(rows, "len").to_numpy()[place.to_numpy()]
        counts = pa.array((column(lists, "tfs").flatten().to_numpy().astype(np.int64) << 32) | size)
        apart = [pa.ListArray.from_arrays(ends, column(rows, "row_id").take(place)), pa.ListArray.from_arrays(ends, counts)]
        return pa.Table.from_arrays([column(lists, "term"), column(lists, "df"), *apart], schema=lists_schema)

    def paged(
        term: pa.Array, ends: np.ndarray, row: np.ndarray, tf: np.ndarray, row_ids: pa.Array, size: np.ndarray,
        corpus: pa.Array, kind: np.ndarray, block: np.ndarray, begin: np.ndarray,
    ) -> pa.RecordBatch:
        """Lists that stand together as pages, from the numbers of their rows; ``begin`` says with which lists a page begins."""
        pages, page_rows = [], []
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(term)]):
            at = slice(ends[a], ends[b])
            rows, place = np.unique(row[at], return_inverse=True)
            inner = pa.array((ends[a : b + 1] - ends[a]).astype(np.int32))
            listed = [pa.ListArray.from_arrays(inner, pa.array(v, pa.int32())) for v in (place, tf[at])]
            df = pa.array(np.diff(ends[a : b + 1]), pa.int32())
            pages.append(written(pa.RecordBatch.from_arrays([term.slice(a, b - a), df, *listed], schema=inside)))
            page_rows.append(written(pa.RecordBatch.from_arrays([row_ids.take(pa.array(rows)), pa.array(size[rows])], schema=inside_rows)))
        named = pa.array(kinds).take(pa.array(kind[begin]))
        columns = [corpus.take(pa.array(begin)), named, pa.array(block[begin], pa.int32()), pa.array(pages, pa.binary()), pa.array(page_rows, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, schema=outside)

    def tokens(found: Iterator[list[str]]) -> tuple[pa.Array, np.ndarray]:
        listed, sizes = [], []
        for some in found:
            listed += some
            sizes.append(len(some))
        return pa.array(listed, pa.string()), np.array(sizes, np.int64)

    def counted_pages(table: pa.Table) -> pa.RecordBatch:
        """Tokens are numbered, and one sort of numbers made of corpus, kind, block, term and row puts equal ones side by side."""
        corpus, corpora = numbered(column(table, "corpus"))
        ids, texts = column(table, "row_id"), column(table, "text").to_pylist()
        pieces, size = tokens(t.split() for t in texts)
        words, word_size = tokens(word.findall(t) if known is None else known for t, known in zip(texts, column(table, "words").to_pylist()))
        # lines that share an id and a length are one row
        same_id = np.cumsum(changes(corpus, numbered(ids)[0]))
        _, first, line_row = np.unique(same_id * (size.max() + 1) + size, return_index=True, return_inverse=True)
        term, vocabulary = numbered(pa.concat_arrays([pieces, words]))
        row = np.concatenate([np.repeat(line_row, size), np.repeat(line_row, word_size)])
        kind = np.repeat(np.arange(2), [len(pieces), len(words)])
        # the empty term of marks is number 0, others begin at 1
        v, u, c = len(vocabulary) + 1, len(first), corpus[first]
        term_sum, corpus_sum = np.append(0, sums(vocabulary)), sums(corpora)
        block = (corpus_sum[c[row]] + term_sum[term + 1]) % blocks
        whole = (((c[row] * 3 + kind) * blocks + block) * v + term + 1) * u + row
        marks = ((c * 3 + 2) * blocks + corpus_sum[c] % blocks) * v * u + np.arange(u)
        whole = np.concatenate([whole, marks])
        whole.sort()
        at = np.flatnonzero(changes(whole))
        tf = np.diff(at, append=len(whole))
        group, row = np.divmod(whole[at], u)
        run = np.flatnonzero(changes(group))
        of, term = np.divmod(group[run], v)
        rest, block = np.divmod(of, blocks)
        c, kind = np.divmod(rest, 3)
        known = pa.concat_arrays([pa.array([""], pa.string()), vocabulary]).take(pa.array(term))
        ids = ids.cast(row_id).take(pa.array(first))
        return paged(known, np.append(run, len(group)), row, tf, ids, size[first], corpora.take(pa.array(c)), kind, block, np.flatnonzero(changes(of)))

    def cut_at_ids(table: pa.Table) -> np.ndarray:
        return np.flatnonzero(changes(*(numbered(column(table, c))[0] for c in ("corpus", "row_id"))))

    def in_parts(table: pa.Table) -> Batches:
        """The numbers of all parts must make one of 63 bits, or the texts are halved; terms and rows are fewer than bytes and lines."""
        at = cut_at_ids(table)
        if len(at) == 1 or 3 * blocks * (table.nbytes + 2) * table.num_rows**2 < 1 << 63:
            yield counted_pages(table)
        else:
            cut = int(at[len(at) // 2])
            yield from in_parts(table.slice(0, cut))
            yield from in_parts(table.slice(cut))

    def counted(batches: Batches) -> Batches:
        """Pages from (corpus, row_id, text, words) sorted by the first two, put together up to where an id changes.

        The texts are those of ``rows.lowered``. Python splits them at the white space that ``text.SPACE`` has, and its word characters
        are those of ``text.WORD`` as far as ``text.PLAIN``; words of other texts are given.
        """
        held: list[pa.RecordBatch] = []
        size = rows = 0
        for batch in batches:
            held.append(batch)
            size, rows = size + batch.nbytes, rows + batch.num_rows
            if size < gathered_bytes and rows < GATHERED_ROWS:
                continue
            table = pa.Table.from_batches(held)
            cut = int(cut_at_ids(table)[-1])
            if cut:
                yield from in_parts(table.slice(0, cut))
                held = pa.Table.from_arrays([column(table.slice(cut), c) for c in table.column_names], table.column_names).to_batches()
                size, rows = sum(b.nbytes for b in held), sum(b.num_rows for b in held)
        if rows:
            yield from in_parts(pa.Table.from_batches(held))

    def repaged(batches: Batches) -> Batches:
        """Pages from lists: corpus, kind, term, df, row_ids, counts."""
        for lists in batches:
            if not lists.num_rows:
                continue
            corpus, corpora = numbered(lists.column(0))
            kind = np.array([kinds.index(k) for k in lists.column(1).to_pylist()], np.int64)
            block = (sums(corpora)[corpus] + sums(lists.column(2))) % blocks
            order = np.lexsort((block, kind, corpus))
            corpus, kind, block = corpus[order], kind[order], block[order]
            found = lists.select(["term", "row_ids", "counts"]).take(pa.array(order))
            ends = np.append(0, np.cumsum(found.column(1).value_lengths().to_numpy(zero_copy_only=False)))
            ids, counts = found.column(1).flatten().cast(row_id), found.column(2).flatten().to_numpy()
            # an id that has several lengths is several rows
            size = counts & 0xFFFFFFFF
            _, first, row = np.unique(numbered(ids)[0] * (size.max() + 1) + size, return_index=True, return_inverse=True)
            at, named = np.flatnonzero(changes(corpus, kind, block)), corpora.take(pa.array(corpus))
            yield paged(found.column(0), ends, row, counts >> 32, ids.take(pa.array(first)), size[first], named, kind, block, at)

    def opened(batches: Batches) -> Batches:
        """Lists of pages(corpus, kind, page, page_rows), or of pages(corpus, kind, page, page_rows, wanted) those of the wanted terms."""
        for pages in batches:
            asked = pages.column(4) if pages.num_columns > 4 else [None] * pages.num_rows
            found = [page_lists(p.as_buffer(), r.as_buffer(), w and w.values) for p, r, w in zip(pages.column(2), pages.column(3), asked)]
            sizes = [lists.num_rows for lists in found]
            if not sum(sizes):
                continue
            place, table = pa.array(np.repeat(np.arange(len(sizes)), sizes)), pa.concat_tables(found)
            columns = [pages.column(0).take(place), pages.column(1).take(place), *(column(table, n) for n in table.column_names)]
            yield pa.RecordBatch.from_arrays(columns, schema=opened_schema)

    def frequencies(batches: Batches) -> Batches:
        """Document frequencies of pages(corpus, kind, page): corpus, kind, term, df, once per page."""
        for pages in batches:
            found = [read(page.as_buffer(), 0, 1) for page in pages.column(2)]
            if found:
                place, table = pa.array(np.repeat(np.arange(len(found)), [t.num_rows for t in found])), pa.concat_tables(found)
                columns = [pages.column(0).take(place), pages.column(1).take(place), *(column(table, n) for n in table.column_names)]
                yield pa.RecordBatch.from_arrays(columns, ["corpus", "kind", "term", "df"])

    def by_block(batches: Batches) -> Iterator[tuple[str, int, list]]:
        """(corpus, rows of the corpus, its pages of one block) of pages(corpus, n, block, page, page_rows) sorted by corpus and block."""
        at, held = None, []
        for pages in batches:
            for corpus, n, block, *page in zip(*(pages.column(i).to_pylist() for i in range(3)), *pages.columns[3:]):
                if held and at != (corpus, n, block):
                    yield at[0], at[1], held
                    held = []
                at = (corpus, n, block)
                # of its own: a batch is not kept for a page
                held.append([p.as_py() for p in page])
        if held:
            yield at[0], at[1], held

    def totals(pages: list) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Number of the term of each list, document frequencies by it, and where the lists of a page end."""
        found = [read(page[0], 0, 1) for page in pages]
        table = pa.concat_tables(found)
        term, _ = numbered(column(table, "term"))
        df = np.bincount(term, weights=column(table, "df").to_numpy()).astype(np.int64)
        return term, df, np.cumsum([t.num_rows for t in found]).tolist()

    def spectrum(batches: Batches) -> Batches:
        """How many terms of a corpus have a document frequency: corpus, df, terms, in parts."""
        for corpus, _, pages in by_block(batches):
            df, many = np.unique(totals(pages)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([corpus] * len(df), pa.string()), pa.array(df), pa.array(many.astype(np.int64))], ["corpus", "df", "terms"])

    def squares(batches: Batches) -> Batches:
        """Squared lengths of rows under TF-IDF from pages of words: corpus, row_id, alone, in parts."""
        for corpus, n, pages in by_block(batches):
            term, df, ends = totals(pages)
            # as rows.tfidf_idf of n + 1
            idf = np.log((n + 2) / (df + 1)) + 1
            for (page, page_rows), begin, end in zip(pages, [0, *ends], ends):
                lists, rows = read(page, 2, 3), column(read(page_rows, 0), "row_id")
                weight = np.repeat(idf[term[begin:end]], column(lists, "rows").value_lengths().to_numpy(zero_copy_only=False))
                parts = (column(lists, "tfs").flatten().to_numpy() * weight) ** 2
                alone = np.bincount(column(lists, "rows").flatten().to_numpy(), weights=parts, minlength=len(rows))
                yield pa.RecordBatch.from_arrays([pa.array([corpus] * len(rows), pa.string()), rows, pa.array(alone)], ["corpus", "row_id", "alone"])

    return SimpleNamespace(counted=counted, repaged=repaged, opened=opened, frequencies=frequencies, spectrum=spectrum, squares=squares)
