"""One object with the operations of a document knowledge base, over tables in a store."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .errors import Forbidden, Invalid, NotFound
from .operators import cache, catalog, embedding, host, search, sync
from .plans import ingest
from .sources import files, tables


class KnowledgeBase:
    """Documents below a root folder, kept searchable in a store of versioned tables."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        store: str,
        config: Config | None = None,
        rerank: Callable[[Column, str], Column] | None = None,
        parser: files.PdfParser = files.missing_parser,
        embed: Callable[[DataFrame], DataFrame] = embedding.with_hashed,
        summariser: embedding.Summariser | None = None,
    ):
        self.spark, self.root, self.store, self.config = spark, root.rstrip("/"), store.rstrip("/"), config or Config()
        self.rerank = rerank or (embedding.overlap if self.config.rerank else None)
        self.parser, self.embed, self.summariser = parser, embed, summariser
        self.scopes = search.StoredScopes(spark, f"{self.store}/scopes", self.config.scope_seconds)
        self._collection: search.Collection | None = None
        self.report = ingest.Report()  # of the last scan that had work to do

    @property
    def collection(self) -> search.Collection:
        if self._collection is None:
            self._collection = ingest.open_collection(self.spark, self.store)
            self._collection.settings = self.config.search_settings()
        return self._collection

    def rescan_documents(self, deep: bool = False) -> dict[str, int]:
        """Brings the tables in step with the files; how many were new, modified and deleted. A changed setting makes its stage and those after it run again, from what the stages before it left.

        Files of unchanged size and time are not read; with ``deep`` every file is, and its checksum compared.
        """
        stored = cache.load_fingerprints(self._stored_fingerprints())
        changed = cache.invalidated(cache.changed_stages(self._settings(), stored))
        scan = ingest.scanned(self.spark, self.root, self.store, self.config, deep)
        index = tables.read(self.spark, f"{self.store}/documents")
        none = self.spark.createDataFrame([], "path string, checksum string, last_modified double, file_size long")
        counts = sync.change_summary(sync.changes(scan, index if index is not None else none)).first().asDict()
        if any(counts.values()) or index is None or changed:
            self._ingest(scan)
        return counts

    def _settings(self) -> dict[str, dict]:
        return self.config.stage_settings() | {"index": {"text_analyzer": self.config.text_analyzer}}

    def _ingest(self, scan: DataFrame | None = None) -> None:
        _, self.report = ingest.ingest(self.spark, self.root, self.store, self.config, self.parser, self.embed, self.summariser, scan)
        # only what has been done is noted
        tables.publish(self.spark.createDataFrame([(k, cache.fingerprint(v)) for k, v in self._settings().items()], "stage string, fingerprint string"), f"{self.store}/fingerprints")
        self._collection = None

    def add_document(self, path: str, metadata: dict[str, str] | None = None) -> DataFrame:
        """Adds one file, wherever it is, with metadata of the user's; its row of documents. A file that cannot be parsed is an error."""
        if files.given(self.spark, [path]) is None:
            raise NotFound(path)
        ingest.add_source(self.spark, self.store, path, metadata)
        self._ingest()
        row = tables.read(self.spark, f"{self.store}/documents").where(F.col("path") == path)
        error = row.select("error").first()
        if error is None or error[0]:
            raise Invalid(f"{path}: {error[0] if error else 'not a supported file'}")
        return row

    def upload_document(self, name: str, content: bytes, metadata: dict[str, str] | None = None) -> DataFrame:
        """Stores content under uploads by a name of its own and adds it."""
        return self.add_document(files.upload(self.spark, self.root, name, content, int(time.time()), uuid.uuid4().hex), metadata)

    def _stored_fingerprints(self) -> str | None:
        rows = tables.read(self.spark, f"{self.store}/fingerprints")
        return tables.to_record({r.stage: r.fingerprint for r in rows.collect()}) if rows is not None else None

    def search_documents(self, query: str, limit: int | None = None, metadata_filter: dict | None = None, search_type: str | None = None, min_score: float = 0.0, session_id: str | None = None) -> DataFrame:
        limit = self.config.vector_search_k if limit is None else limit
        kind = search_type or ("hybrid" if self.config.enable_hybrid_search else "vector")
        try:
            search.validated(query, limit, min_score)
        except ValueError as e:
            raise Invalid(str(e)) from e
        more = {"search_type": kind, "min_score": min_score, "rerank": self.rerank}
        if session_id and self.config.scope:
            return search.scoped_search(self.collection, query, session_id, self.scopes, time.time(), limit, metadata_filter, **more)
        return search.search(self.collection, query, limit, metadata_filter, **more)

    def list_documents(self, metadata_filter: dict | None = None, page: int = 1, size: int = 20) -> tuple[DataFrame, dict]:
        return catalog.listed(catalog.filtered(self.collection.documents, metadata_filter), page, size)

    def get_document(self, identifier: str) -> DataFrame:
        rows = catalog.resolved(self.collection.documents, identifier, self.root)
        if not rows.limit(1).count():
            raise NotFound(identifier)
        return catalog.with_chunks(rows, self.collection.chunks.select("document_id", "chunk_index", "chunk_id", "text"))

    def get_chunks(self, identifier: str, indices: str) -> DataFrame:
        rows = catalog.resolved(self.collection.documents, identifier, self.root).select("document_id").limit(1).collect()
        if not rows:
            raise NotFound(identifier)
        return catalog.chunks_at(self.collection.chunks, rows[0].document_id, indices)

    def resource(self, uri: str) -> str:
        """JSON of doc://list, doc://<id or path>, and doc://<id or path>/chunk/<n,n,...>."""
        scheme, _, rest = uri.partition("://")
        if scheme != "doc" or not rest:
            raise Invalid(f"no resource {uri!r}")
        if rest == "list":
            rows = catalog.listed_all(self.collection.documents)
        elif "/chunk/" in rest:
            name, _, indices = rest.rpartition("/chunk/")
            rows = self.get_chunks(name, indices)
        else:
            rows = self.get_document(rest)
        return "[" + ",\n".join(r.json for r in catalog.as_json(rows).collect()) + "]"  # a document's rows, or a listing

    def host_metrics(self) -> DataFrame:
        return host.metrics(self.spark)

    def remove_document(self, document_id: str) -> None:
        """Deletes a document, unless its file is still below root (uploads may go)."""
        row = self.collection.documents.where(F.col("document_id") == document_id)
        if not row.limit(1).count():
            raise NotFound(document_id)
        there = files.scan(self.spark, self.root, self.config.supported_extensions).select("path")
        if not sync.deletable(row, self.root, there).first().may_delete:
            raise Forbidden(f"{document_id} would come back with the next scan: delete its file")
        ingest.removed(self.spark, self.store, document_id)
        self._collection = None

    def similar_documents(self, document_id: str, limit: int = 5) -> DataFrame:
        return search.similar_documents(self.collection, document_id, limit)

    def suggestions(self, fragment: str) -> DataFrame:
        return search.suggestions(self.collection.documents, fragment)

    def statistics(self) -> DataFrame:
        return catalog.statistics(self.collection.documents, self.collection.chunks)
