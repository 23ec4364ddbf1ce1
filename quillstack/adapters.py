"""Plug-in points for page rendering, language models and embedding models, with deterministic offline stand-ins.

An adapter is a plain object with the methods below. It is made on the executors by a factory without arguments, once
for each partition, so clients and secrets never enter a plan.
"""

from __future__ import annotations

import base64
import re
import time
import zlib
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


class Renderer(Protocol):
    """data is one object for all pages of a file, so a renderer may keep what it has opened last."""

    def info(self, data: bytes) -> dict[str, Any]: ...

    def size(self, data: bytes, page_number: int) -> tuple[float, float]: ...

    def render(self, data: bytes, page_number: int, zoom: float) -> tuple[bytes, int, int]: ...


class Model(Protocol):
    def answer(self, system_prompt: str, user_prompt: str, images: list[str]) -> tuple[str, int, int]: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


INFO = "page_count int, title string, author string, subject string, creator string, creation_date string, modification_date string"
IMAGE = "source_file string, position int, page_number int, image_base64 string, width int, height int, mime_type string"


def pdf_info(files: DataFrame, make: Callable[[], Renderer]) -> DataFrame:
    """(source_file, page_count, title, ...) of binary files (path, content); missing texts are empty. With parts of files
    (path, part, content), a row for each part."""
    names = [f.split()[0] for f in INFO.split(", ")]
    keys = _file_keys(files)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        renderer = make()
        for frame in frames:
            rows = [{n: (i := renderer.info(bytes(c))).get(n, 0 if n == "page_count" else "") for n in names} for c in frame["content"]]
            yield pd.concat([frame[keys].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    return _by_name(files, keys).mapInPandas(run, f"{_kinds(files, keys)}, {INFO}")


def _file_keys(files: DataFrame) -> list[str]:
    return ["source_file", *[c for c in ("part",) if c in files.columns]]


def _by_name(files: DataFrame, keys: list[str]) -> DataFrame:
    return files.select(F.col("path").alias("source_file"), *keys[1:], "content")


def _kinds(files: DataFrame, keys: list[str]) -> str:
    return ", ".join(["source_file string", *[f"{k} {files.schema[k].dataType.simpleString()}" for k in keys[1:]]])


def fit_zoom(width: float, height: float, dpi: float, max_dimension: int | None) -> float:
    """Zoom for a resolution (72 points an inch), lowered so that no side exceeds the limit."""
    zoom, longest = dpi / 72.0, max(width, height)
    return max_dimension / longest if max_dimension and longest * zoom > max_dimension else zoom


def wanted_pages(info: DataFrame, start: int = 1, end: int | None = None) -> DataFrame:
    """(source_file, page_number) of a range; the end is clamped to the document, None or 0 means its last page."""
    last = F.least(F.lit(end), F.col("page_count")) if end else F.col("page_count")
    return info.where(last >= start).select("source_file", F.explode(F.sequence(F.lit(start), last)).alias("page_number"))


#: Characters of images, and rows, that a task holds before it passes them on.
IMAGE_CHARS, IMAGE_ROWS = 4 << 20, 2_000


def render_pages(
    files: DataFrame, wanted: DataFrame, make: Callable[[], Renderer], dpi: float = 150, fmt: str = "png", max_dimension: int | None = 2048, strict: bool = False, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Images (IMAGE, and the columns to keep) of wanted pages (source_file, page_number[, position][, columns to keep]).

    position is the place of a request in its list, by default the page number; a page that is asked for twice comes
    twice. No side of an image is longer than max_dimension. Pages outside a document are left out; with strict they
    raise an error."""
    place = F.col("position") if "position" in wanted.columns else F.col("page_number")
    keys = _file_keys(files)
    asked = wanted.select(*keys, place.cast("int").alias("position"), F.col("page_number").cast("int").alias("page_number"), *keep)
    lists = asked.groupBy(*keys, *keep).agg(F.sort_array(F.collect_list(F.struct("position", "page_number"))).alias("pages"))
    return render_lists(files, lists, make, dpi, fmt, max_dimension, strict, keep)


def render_lists(
    files: DataFrame, lists: DataFrame, make: Callable[[], Renderer], dpi: float = 150, fmt: str = "png", max_dimension: int | None = 2048, strict: bool = False, keep: tuple[str, ...] = ()
) -> DataFrame:
    """The same for lists (source_file, pages array<struct<position, page_number>>[, page_count][, columns to keep]).

    Each list meets its file once, so the bytes of a file are not repeated for its pages, and images are passed on while
    the file is read. Files may come in parts (path, part, content), then lists name the part and page_number counts
    inside it. page_count, if there, stands for what the renderer says."""
    keys = _file_keys(files)
    numbers = {"_at": F.col("pages.position"), "_n": F.col("pages.page_number"), "_count": F.col("page_count").cast("int") if "page_count" in lists.columns else F.lit(-1)}
    joined = _by_name(files, keys).join(lists.select(*keys, *[c.alias(n) for n, c in numbers.items()], *keep), keys)
    kinds = "".join(f", {k} {lists.schema[k].dataType.simpleString()}" for k in keep)
    columns, read = [*[f.split()[0] for f in IMAGE.split(", ")], *keep], ["source_file", "content", *numbers, *keep]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        renderer, rows, held = make(), [], 0
        for frame in frames:
            for name, data, places, wanted, total, *kept in frame[read].itertuples(index=False):
                data = bytes(data)
                total = renderer.info(data)["page_count"] if total < 0 else total
                for at, n in zip(places.tolist(), wanted.tolist(), strict=True):
                    if 1 <= n <= total:
                        image, w, h = renderer.render(data, n, fit_zoom(*renderer.size(data, n), dpi, max_dimension))
                        rows.append((name, at, n, base64.b64encode(image).decode(), w, h, f"image/{fmt}", *kept))
                        held += len(rows[-1][3])
                    elif strict:
                        raise ValueError(f"page {n} of {name} is out of range (1-{total})")
                    if held >= IMAGE_CHARS or len(rows) >= IMAGE_ROWS:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return joined.select(*read).mapInPandas(run, IMAGE + kinds)


def thumbnails(files: DataFrame, make: Callable[[], Renderer], max_size: int = 400, fmt: str = "png") -> DataFrame:
    """The first page of each file, scaled so that its longer side is max_size; files without pages give none."""
    first = files.select(F.col("path").alias("source_file"), F.lit(1).alias("page_number"))
    return render_pages(files, first, make, dpi=1e9, fmt=fmt, max_dimension=max_size)


REPLY = "reply string, input_tokens int, output_tokens int, attempts int, error string"


def ask_model(prompts: DataFrame, keys: list[str], make: Callable[[], Model], max_retries: int = 3, wait: Callable[[float], None] = time.sleep, accept: Callable[[str], bool] = bool) -> DataFrame:
    """keys and REPLY for prompts (keys, system_prompt, user_prompt, images). A reply that is not accepted is asked again,
    with waits of 2, 4, ... seconds in between; the last reply is returned even if it is not accepted. If every attempt
    fails, reply is null and error says why."""
    kinds = ", ".join(f"{k} {prompts.schema[k].dataType.simpleString()}" for k in keys)

    def one(model: Model, system: str, user: str, images: list[str]) -> tuple:
        reply, used, error = None, (0, 0), None
        for attempt in range(1, max_retries + 1):
            try:
                reply, *used = model.answer(system, user, images)
                error = None
                if accept(reply):
                    break
            except Exception as e:  # noqa: BLE001  whatever a client raises counts as a failed attempt
                error = f"{type(e).__name__}: {e}" if reply is None else None
            if attempt < max_retries:
                wait(2.0**attempt)
        return (reply, *used, attempt, error)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            rows = [one(model, s, u, [] if i is None else [x for x in i if x is not None]) for s, u, i in frame[["system_prompt", "user_prompt", "images"]].itertuples(index=False)]
            yield pd.concat([frame[keys].reset_index(drop=True), pd.DataFrame(rows, columns=[f.split()[0] for f in REPLY.split(", ")])], axis=1)

    return prompts.select(*keys, "system_prompt", "user_prompt", "images").mapInPandas(run, f"{kinds}, {REPLY}")


def call_embedder(embedder: Embedder, texts: list[str]) -> list[list[float]]:
    """Vectors of texts; a service that cannot be reached raises ConnectionError, any other failure RuntimeError."""
    try:
        return embedder.embed(texts)
    except Exception as e:  # noqa: BLE001  clients raise classes of their own
        if isinstance(e, ConnectionError) or "Connection" in type(e).__name__ or "refused" in str(e).lower():
            raise ConnectionError(f"the embedding service cannot be reached: {e}") from e
        raise RuntimeError(f"the texts could not be embedded: {e}") from e


def embed_text(embedder: Embedder, text: str | None) -> list[float]:
    """Vector of one text, for questions; a blank text raises ValueError."""
    if not text or not text.strip():
        raise ValueError("a blank text has no vector")
    return call_embedder(embedder, [text])[0]


def embed_column(make: Callable[[], Embedder]) -> Callable[[Column], Column]:
    """Embedding of a text column by an embedder; blank texts get an empty vector without being sent."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = make()
        for texts in batches:
            real = [(i, t) for i, t in enumerate(texts) if t and t.strip()]
            vectors = call_embedder(embedder, [t for _, t in real]) if real else []
            out: list[list[float]] = [[] for _ in range(len(texts))]
            for (i, _), v in zip(real, vectors, strict=True):
                out[i] = [float(x) for x in v]
            yield pd.Series(out)

    return run


def embedder_health(list_models: Callable[[], list[str]], model: str) -> dict[str, Any]:
    """State of an embedding service: list_models asks it for its models and raises if it cannot be reached."""
    state: dict[str, Any] = {"healthy": False, "running": False, "model_available": False, "model": model, "error": None}
    try:
        names = list_models()
    except Exception as e:  # noqa: BLE001  any failure means that the service is not there
        return state | {"error": f"{type(e).__name__}: {e}"}
    available = any(n.startswith(model) for n in names)
    return state | {"healthy": available, "running": True, "model_available": available, "error": None if available else f"model {model} is not installed"}


def hash_embedding(text: Column, dimensions: int = 64) -> Column:
    """Offline stand-in: counts of lower-cased words hashed into cells, scaled to length one."""
    return embed_column(lambda: HashEmbedder(dimensions))(text)


class HashEmbedder:
    """Word counts by hash cell; a text without words has the zero vector."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            cells = [zlib.crc32(w.encode()) % self.dimensions for w in re.findall(r"\w+", text.lower())]
            counts = np.bincount(cells, minlength=self.dimensions).astype(np.float64) if cells else np.zeros(self.dimensions)
            out.append((counts / max(np.linalg.norm(counts), 1e-9)).tolist())
        return out


class PlainTextRenderer:
    """Stand-in renderer: a file is UTF-8 text, form feeds separate its pages, an image is the page's bytes."""

    def __init__(self):
        self.data, self.pages = b"", [b""]

    def info(self, data: bytes) -> dict[str, Any]:
        return {"page_count": data.count(b"\f") + 1 if data else 0}

    def size(self, data: bytes, page_number: int) -> tuple[float, float]:
        return 595.0, 842.0

    def render(self, data: bytes, page_number: int, zoom: float) -> tuple[bytes, int, int]:
        if data is not self.data:
            self.data, self.pages = data, data.split(b"\f")
        return self.pages[page_number - 1], round(595 * zoom), round(842 * zoom)


class EchoModel:
    """Stand-in model: gives the text of the last image (a data URL or bare base64) back as the page's content.

    Braces and backticks of the text are written as JSON escapes, since a reply's JSON part is found by them."""

    def answer(self, system_prompt: str, user_prompt: str, images: list[str]) -> tuple[str, int, int]:
        import json

        text = base64.b64decode(images[-1].rpartition(",")[2] if images else "").decode("utf-8", errors="replace")
        quoted = json.dumps(text, ensure_ascii=False).replace("{", "\\u007b").replace("}", "\\u007d").replace("`", "\\u0060")
        return f'{{"content": {quoted}}}', len(system_prompt) + len(user_prompt), len(text)
