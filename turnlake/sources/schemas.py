"""The data model: explicit schemas, never inferred."""

from pyspark.sql import types as T

SCHEMA_VERSION = 1
ROLES = ("system", "user", "assistant")
BACKENDS = ("lorem", "vllm")
DEFAULT_PROJECT = ("default", "General")
DEFAULT_TITLE = "New chat"


def _of(*fields: tuple[str, str, bool]) -> T.StructType:
    kinds = {"s": T.StringType(), "l": T.LongType(), "i": T.IntegerType(), "t": T.TimestampType()}
    return T.StructType([T.StructField(n, kinds[k], null) for n, k, null in fields])


PROJECTS = _of(("id", "s", False), ("name", "s", False), ("created_at", "t", False), ("updated_at", "t", False))
CONVERSATIONS = _of(("id", "s", False), ("project_id", "s", False), ("title", "s", False), ("model_profile", "s", False), ("created_at", "t", False), ("updated_at", "t", False))
MESSAGES = _of(("id", "l", False), ("conversation_id", "s", False), ("role", "s", False), ("content", "s", False), ("model_profile", "s", True), ("created_at", "t", False))
PROFILES = _of(("key", "s", False), ("label", "s", False), ("backend", "s", False), ("base_url", "s", True), ("model", "s", True))
DELTAS = _of(("conversation_id", "s", False), ("message_seq", "l", False), ("chunk_index", "i", False), ("delta", "s", False))
CHUNK = "id string, object string, created bigint, model string, choices array<struct<index:int,delta:struct<content:string>,finish_reason:string>>"
PROFILE_ITEMS = "array<struct<key:string,label:string,base_url:string,model:string>>"
