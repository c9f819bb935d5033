"""Names of artifacts under a storage root, and the guard on names that come from outside."""

from __future__ import annotations

from ..errors import InvalidKey


def checked(key: str, may_be_empty: bool = False) -> str:
    """key, if it stays within its folder: no backslash, no empty, "." or ".." part, not absolute."""
    if not key and may_be_empty:
        return key
    parts = key.split("/")
    if "\\" in key or key.startswith("/") or any(p in ("", ".", "..") for p in parts):
        raise InvalidKey(f"not a key: {key!r}")
    return key


def shard_name(shard_id: int) -> str:
    return f"shard-{shard_id:04d}"


# The paths of artifacts, by what they hold.
PATHS = {
    "dataset_vectors": "datasets/{version}/vectors",
    "dataset_metadata": "datasets/{version}/metadata",
    "dataset_info": "datasets/{version}/info.json",
    "index_manifest": "indexes/{version}/manifest.json",
    "index_shards": "indexes/{version}/shards",
    "index_shard": "indexes/{version}/shards/shard_id={shard}",
    "index_centroids": "indexes/{version}/centroids",
    "index_codebook": "indexes/{version}/codebook",
    "index_lexical": "indexes/{version}/lexical",
    "worker_plan": "indexes/{version}/worker_plan.json",
    "worker_output": "indexes/{version}/workers/{worker:04d}/output.json",
    "alias": "aliases/{version}.json",
}


def key(kind: str, version: str, **more: int) -> str:
    return PATHS[kind].format(version=checked(version), **more)
