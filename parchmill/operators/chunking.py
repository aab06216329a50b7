"""Overlapping chunks of paged text, and embeddings by an injected model."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from parchmill.session import bounded_batches

#: Fixed format: the page headers of transcriptions.
HEADER = re.compile(r"^--- Page (\d+)(?: \([^)]+\))? ---$")
CHUNKS = "document_id long, chunk_index int, text string, page_hint int"


def paragraphs(text: str) -> Iterator[tuple[str, int | None]]:
    """(paragraph, page): runs of lines that are not blank; page headers end a paragraph and set the page."""
    lines, page = [], None
    for line in [*text.splitlines(), ""]:
        header = HEADER.match(line)
        if (header or not line.strip()) and lines:
            if joined := "\n".join(lines).strip():
                yield joined, page
            lines = []
        if header:
            page = int(header[1])
        elif line.strip():
            lines.append(line)


def chunk_text(text: str | None, size: int = 2000, overlap: int = 256) -> list[tuple[str, int | None]]:
    """(chunk, page) of at most ``size`` characters; each begins with the last ``overlap`` characters of the one before."""
    out: list[tuple[str, int | None]] = []
    window, page, only_overlap = "", None, True

    def emit(body: str, at: int | None) -> None:
        nonlocal window, page, only_overlap
        out.append((body, at))
        window, page, only_overlap = (body[-overlap:] if overlap else ""), at, True

    for body, at in paragraphs(text or ""):
        while True:
            joined = f"{window}\n\n{body}" if window else body
            if len(joined) <= size:
                page = at if page is None or not window else page
                window, only_overlap = joined, False
                break
            if window and not only_overlap:
                emit(window, page)
            elif window:
                window = ""
            else:
                step = size - overlap
                for start in range(0, len(body), step):
                    emit(body[start : start + size], at)
                    if start + size >= len(body):
                        break
                break
    if window and not only_overlap:
        out.append((window, page))
    return out


def chunk_documents(docs: DataFrame, size: int = 2000, overlap: int = 256) -> DataFrame:
    """Chunks of (id, content), a document at a time inside Arrow batches."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than the chunk size")
    bounded_batches(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(d, i, t, p) for d, text in zip(f["id"], f["content"]) for i, (t, p) in enumerate(chunk_text(text, size, overlap))]
            yield pd.DataFrame(rows, columns=["document_id", "chunk_index", "text", "page_hint"]).astype({"page_hint": "Int32"})

    return docs.select("id", "content").mapInPandas(run, CHUNKS)


def hash_embedding(text: str, width: int = 64) -> list[float]:
    """A deterministic stand-in for an embedding model: signed counts of hashed words, unit length."""
    v = [0.0] * width
    for w in text.lower().split():
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        v[h % width] += 1.0 if h >> 63 else -1.0
    n = sum(x * x for x in v) ** 0.5
    return [x / n for x in v] if n else v


def embed_chunks(chunks: DataFrame, model: Callable[[list[str]], list[list[float]]], batch: int = 96) -> DataFrame:
    """chunks with ``embedding`` and ``error``: the model gets batches; a batch that fails marks its rows, not the task."""
    schema = ", ".join(f"{n} {t}" for n, t in chunks.dtypes) + ", embedding array<float>, error string"
    bounded_batches(chunks.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            vectors: list = []
            errors: list = []
            for i in range(0, len(f), batch):
                part = f["text"].iloc[i : i + batch].tolist()
                try:
                    vectors += model(part)
                    errors += [None] * len(part)
                except Exception as e:  # noqa: BLE001  the model is foreign code
                    vectors += [None] * len(part)
                    errors += [f"{type(e).__name__}: {e}"[:200]] * len(part)
            yield f.assign(embedding=vectors, error=errors)

    return chunks.mapInPandas(run, schema)
