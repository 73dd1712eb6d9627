"""Schema documents: from files, from URLs through a fetcher, with their references inlined; and corpora as DataFrames."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import is_url, join_url, map_prefix, url_path
from ..model import DEFAULT, ComposeError, PayloomError, ResolveError, SchemaBase, Vocabulary

#: Seconds for a fetch.
TIMEOUT = 10
Fetcher = Callable[[str], str]


def http_fetch(url: str, timeout: float = TIMEOUT) -> str:
    """Text at a URL; a status other than 2xx is an error."""
    try:
        with urllib.request.urlopen(url, timeout=timeout) as answer:  # noqa: S310
            return answer.read().decode("utf-8")
    except (urllib.error.URLError, OSError, ValueError) as e:
        raise ResolveError("NetworkError", f"{url} does not answer with a document: {e}", url=url) from e


def parse_json(text: str) -> Any:
    try:
        return json.loads(text, parse_constant=_no_constant, parse_float=_finite)
    except (ValueError, RecursionError) as e:
        raise ResolveError("InvalidJson", f"invalid JSON: {e}") from e


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def _finite(text: str) -> float:
    number = float(text)
    if number in (float("inf"), float("-inf")):
        raise ValueError(f"{text} is beyond all numbers")
    return number


class Documents:
    """Loads documents and keeps them, so that each is read once however many schemas refer to it."""

    def __init__(self, base: SchemaBase | None = None, fetch: Fetcher = http_fetch, vocabulary: Vocabulary = DEFAULT):
        self.base, self._fetch, self._held, self.vocabulary = base or SchemaBase(), fetch, {}, vocabulary

    def file(self, path: str | Path) -> Any:
        path = Path(path)
        key = f"file:{path.absolute()}"
        if key not in self._held:
            if not path.exists():
                raise ResolveError("FileNotFound", f"file not found: {path}", path=str(path))
            try:
                text = path.read_text("utf-8")
            except (OSError, UnicodeDecodeError) as e:
                raise ResolveError("ReadError", f"cannot read {path}: {e}", path=str(path)) from e
            self._held[key] = parse_json(text)
        return self._held[key]

    def url(self, url: str) -> Any:
        if url not in self._held:
            self._held[url] = parse_json(self._fetch(url))
        return self._held[url]

    def any(self, where: str) -> Any:
        return self.url(where) if is_url(where) else self.file(where)

    # References.

    def bundle(self, schema: Any, folder: str | Path) -> Any:
        """With references inlined, files being looked for in folder."""
        return self._inlined(schema, schema, str(folder), None, ())

    def bundle_remote(self, schema: Any, url: str) -> Any:
        """With references inlined, relative ones being joined to url."""
        return self._inlined(schema, schema, None, url, ())

    def _inlined(self, value: Any, root: Any, folder: str | None, url: str | None, stack: tuple) -> Any:
        """stack: (document, fragment) of all references that lead here."""
        if isinstance(value, list):
            return [self._inlined(v, root, folder, url, stack) for v in value]
        if not isinstance(value, dict):
            return value
        ref = value.get("$ref")
        if not isinstance(ref, str) or ref == "#":
            return {k: self._inlined(v, root, folder, url, stack) for k, v in value.items()}
        place, _, fragment = ref.partition("#")
        if place:
            where, new_folder, new_url = self._where(place, folder, url)
        else:
            where, new_folder, new_url = id(root), folder, url
        if (where, fragment) in stack:
            raise ResolveError("BundleError", f"inlining {ref} leads back to it: the reference is circular", ref=ref)
        target_root = root if not place else self._referred(where, ref)
        target = navigate(target_root, fragment) if fragment else target_root
        if target is None:
            raise ResolveError("BundleError", f"{ref} cannot be inlined: it points nowhere", ref=ref)
        target = self._inlined(target, target_root, new_folder, new_url, (*stack, (where, fragment)))
        own = {k: self._inlined(v, root, folder, url, stack) for k, v in value.items() if k != "$ref"}
        return {**own, **{k: v for k, v in target.items() if k not in own}} if isinstance(target, dict) else own

    def _where(self, place: str, folder: str | None, url: str | None) -> tuple[str, str | None, str | None]:
        """Document of a reference, and the folder or URL against which its own references are read."""
        if url is not None:
            full = join_url(place, url)
            return full, None, full
        if is_url(place) and not (self.base.local and self.base.remote and place.startswith(self.base.remote)):
            return place, folder, None
        path = map_prefix(place, self.base.local, self.base.remote) if is_url(place) else str(Path(folder) / place)
        return path, str(Path(path).parent), None

    def _referred(self, where: str, ref: str) -> Any:
        try:
            return self.any(where)
        except ResolveError as e:
            raise ResolveError("BundleError", f"{ref} cannot be inlined: {e.message}", ref=ref) from e

    def capability_schema(self, url: str) -> Any:
        """Schema that a capability names, with its references inlined."""
        try:
            if not is_url(url):
                return self.bundle(self.file(url), Path(url).parent)
            if self.base.local is None:
                return self.bundle_remote(self.url(url), url)
            path = self._local(url)
            return self.bundle(self.file(path), Path(path).parent)
        except PayloomError as e:
            raise ComposeError("SchemaFetch", f"the schema {url} cannot be had: {e.message}", url=url) from e

    def _local(self, url: str) -> str:
        if self.base.remote and url.startswith(self.base.remote):
            return map_prefix(url, self.base.local, self.base.remote)
        path = url_path(url)
        if path is None:
            raise ComposeError("InvalidUrl", f"'{url}' names no document: it has no path", url=url)
        return map_prefix(path, self.base.local, None)

    def profile(self, url: str) -> Any:
        try:
            return self.any(url)
        except ResolveError as e:
            raise ComposeError("ProfileFetch", f"the profile {url} cannot be had: {e.message}", url=url) from e


def navigate(value: Any, pointer: str) -> Any:
    """Member at a JSON Pointer; None where there is none. Arrays are not entered."""
    for part in pointer.strip("/").split("/") if pointer.strip("/") else ():
        if not isinstance(value, dict):
            return None
        value = value.get(part.replace("~1", "/").replace("~0", "~"))
        if value is None:
            return None
    return value


def schema_files(path: str | Path) -> list[Path]:
    """The .json files at or below a path, in order; folders that cannot be read are passed over."""
    path = Path(path)
    if path.is_file():
        return [path] if path.suffix == ".json" else []
    found: list[Path] = []
    try:
        for x in path.iterdir():
            found += schema_files(x) if x.is_dir() else [x] if x.suffix == ".json" else []
    except OSError:
        return found
    return sorted(found)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """uri and content of all .json files below a path that Spark reads, whatever store holds them."""
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return texts.select(F.col("_metadata.file_path").alias("uri"), F.col("value").alias("content"))


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """payload_id and payload of a folder of JSON documents, one to a file."""
    return read_corpus(spark, path).select(F.col("uri").alias("payload_id"), F.col("content").alias("payload"))
