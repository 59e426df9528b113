"""What the network does: embedding, generating, judging. Each provider is a picklable object with one method; offline
ones are deterministic, remote ones speak HTTP to services that understand the usual chat and embedding requests."""

from __future__ import annotations

import contextlib
import glob
import hashlib
import json
import os
import re
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.judging import VERDICT, reply_text, verdict


# Where the services are that settings may name without an address, and where keys are looked for last.
BASE_URLS = {"openai": "https://api.openai.com/v1", "deepinfra": "https://api.deepinfra.com/v1/openai"}
LAST_KEY = "OPENAI_API_KEY"
NO_ANSWER = "NOT_FOUND"
#: Texts that an embedder gets in one call.
EMBED_ROWS = 1024


class Embedder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Words hashed to signed components: offline, the same everywhere."""

    backend, name = "hash", "hash-words"

    def __init__(self, dim: int = 256):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = zlib.crc32(w.encode())
                out[i, h % self.dim] += 1.0 if h >> 31 else -1.0
        return out


class KeywordEmbedder:
    """One component for each keyword that a text has."""

    backend, name = "keyword", "keyword-flags"

    def __init__(self, words: list[str]):
        self.words, self.dim = [w.lower() for w in words], len(words)

    def encode(self, texts: list[str]) -> np.ndarray:
        return np.array([[float(w in t) for w in self.words] for t in map(str.lower, texts)], np.float32).reshape(len(texts), self.dim)


class RateLimited(Exception):
    """A provider's refusal for now; retry_after in seconds if it says so."""

    def __init__(self, retry_after: str | float | None = None):
        super().__init__("rate limited")
        self.retry_after = retry_after


def wait_seconds(retry_after: str | float | None, default: float) -> float:
    try:
        return max(0.0, float(retry_after)) if retry_after is not None else default
    except ValueError:
        return default


def with_retry(call: Callable, retries: int = 3, pause: float = 5.0, before: float = 0.0, sleep: Callable[[float], None] = time.sleep):
    """call(), again after a pause when it is rate limited, `retries` times at most; `before` seconds before each call."""
    for attempt in range(retries + 1):
        if before > 0:
            sleep(before)
        try:
            return call()
        except RateLimited as e:
            if attempt == retries:
                raise
            if (s := wait_seconds(e.retry_after, pause)) > 0:
                sleep(s)


def api_key(name: str | None, env=None) -> str:
    """The key of that name in the environment, else the usual one."""
    env = os.environ if env is None else env
    key = env.get(name or "") or env.get(LAST_KEY)
    if not key:
        raise ValueError(f"no API key: set {name or LAST_KEY}")
    return key


class Endpoint:
    """POSTs JSON below an address and reads JSON; status 429 is RateLimited. Holds no connection, so it pickles."""

    def __init__(self, base_url: str, key: str, timeout: float = 90.0):
        self.base_url, self.key, self.timeout = base_url.rstrip("/"), key, timeout

    def __call__(self, path: str, body: dict) -> dict:
        head = {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"}
        request = urllib.request.Request(f"{self.base_url}/{path}", json.dumps(body).encode(), head)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            if e.code == 429:
                raise RateLimited(e.headers.get("Retry-After")) from None
            raise


def endpoint(settings: dict) -> Endpoint:
    """From a section of the settings: backend or base_url, api_key_env, timeout_seconds. The key is read here, once."""
    url = settings.get("base_url") or BASE_URLS.get(settings["backend"])
    if not url:
        raise ValueError(f"backend {settings['backend']} needs a base_url")
    return Endpoint(url, api_key(settings.get("api_key_env")), settings["timeout_seconds"])


class EmbeddingClient:
    """texts -> [{"index", "embedding"}]."""

    def __init__(self, post: Callable[[str, dict], dict], model: str):
        self.post, self.model = post, model

    def __call__(self, texts: list[str]) -> list[dict]:
        return self.post("embeddings", {"model": self.model, "input": texts})["data"]


class ChatClient:
    """messages -> the first choice's text, NOT_FOUND if it is blank."""

    def __init__(self, post: Callable[[str, dict], dict], model: str, temperature: float = 0.0, max_tokens: int = 512, num_ctx: int | None = None, **more):
        self.post, self.body = post, {"model": model, "temperature": temperature, "max_tokens": max_tokens} | ({"num_ctx": num_ctx} if num_ctx else {}) | more

    def reply(self, messages: list[dict]) -> dict:
        return self.post("chat/completions", self.body | {"messages": messages})

    def __call__(self, messages: list[dict]) -> str:
        said = self.reply(messages)["choices"][0]["message"]["content"]
        if isinstance(said, list):  # given in parts
            said = "".join(p if isinstance(p, str) else p.get("text") or "" for p in said)
        return (said or "").strip() or NO_ANSWER


class JudgeClient(ChatClient):
    """prompt -> the whole reply, whose text is looked for later; JSON is asked for, at temperature zero."""

    def __init__(self, post, model: str, max_tokens: int = 512):
        super().__init__(post, model, 0.0, max_tokens, response_format={"type": "json_object"})

    def __call__(self, prompt: str) -> dict:
        return self.reply([{"role": "user", "content": prompt}])


class RemoteEmbedder:
    """Batches sent to post(texts) -> [{"index", "embedding"}], put in the order of their indexes."""

    backend = "remote"

    def __init__(self, post: Callable[[list[str]], Iterable[dict]], dim: int = 0, name: str = "remote", batch: int = 32, retries: int = 3, pause: float = 5.0, before: float = 0.0):
        self.post, self.dim, self.name, self.batch, self.retries, self.pause, self.before = post, dim, name, batch, retries, pause, before

    def encode(self, texts: list[str]) -> np.ndarray:
        rows: list[list[float]] = []
        for lo in range(0, len(texts), self.batch):
            part = texts[lo : lo + self.batch]
            got = sorted(with_retry(lambda p=part: list(self.post(p)), self.retries, self.pause, self.before), key=lambda r: r["index"])
            if len(got) != len(part):
                raise ValueError(f"{len(part)} texts were sent, {len(got)} embeddings came back")
            rows += [r["embedding"] for r in got]
        return np.asarray(rows, np.float32)


def normalise(m: np.ndarray) -> np.ndarray:
    m = np.asarray(m, np.float32)
    if m.ndim != 2:
        raise ValueError("embeddings must be a matrix")
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def embed(df: DataFrame, provider: Embedder, text_col: str = "text", out_col: str = "vector", normalize: bool = True) -> DataFrame:
    """df with a vector for each text: one call for EMBED_ROWS texts at most.

    Rows stay Arrow arrays; only the texts of one call, and their vectors, are Python's at a time.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.ArrayType(T.FloatType()))])

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, EMBED_ROWS):
                b = whole.slice(lo, EMBED_ROWS)
                m = provider.encode([t or "" for t in b.column(text_col).to_pylist()])
                if len(m) != b.num_rows or m.ndim != 2:
                    raise ValueError("a provider must return one vector for each text")
                m = np.ascontiguousarray(normalise(m) if normalize else m, np.float32)
                cuts = pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(cuts, pa.array(m.ravel()))], [*b.schema.names, out_col])

    return df.mapInArrow(run, schema)


class Journal:
    """Replies as they come in, one line each, in a folder that all workers see: a task that runs again asks only the rest.

    A task appends to a file of its own and reads those that earlier tries of the same partition have left, so no more
    than a partition's replies are in hand. A line that was torn off is no reply.
    """

    def __init__(self, folder: str):
        self.folder = folder

    def open(self, partition: int, attempt: int):
        os.makedirs(self.folder, exist_ok=True)
        known, own = {}, f"{self.folder}/{partition:06d}-{attempt}.jsonl"
        for name in sorted(glob.glob(f"{glob.escape(self.folder)}/{partition:06d}-*.jsonl")):
            with open(name, encoding="utf-8") as f:
                for line in f:
                    with contextlib.suppress(ValueError):
                        known |= dict([json.loads(line)])
        out = open(own, "a", encoding="utf-8")  # noqa: SIM115  for as long as the task

        def keep(key: str, reply: str) -> None:
            known[key] = reply
            out.write("\n" + json.dumps([key, reply], ensure_ascii=False))
            out.flush()
            os.fsync(out.fileno())

        return known, keep


def generate(
    df: DataFrame, call: Callable[[list[dict]], str] | None, messages_col: str = "messages", out_col: str = "raw_answer", retries: int = 3, pause: float = 5.0, before: float = 0.0,
    in_flight: int | None = None, journal: str | None = None,
) -> DataFrame:
    """df with each prompt's answer, or null where there is no prompt or the provider failed, in whatever way. Without a
    provider all answers are null.

    `before` seconds pass before each call, and after them `pause` if the provider refuses. in_flight bounds the calls that
    are open at a time, of all workers: prompts go to so many partitions, each of which waits so many times as long. So the
    whole job keeps to one call in `before` seconds, however many workers there are. journal: a folder that all
    workers see, for the replies (see Journal); with it a prompt is asked once even if its task fails and runs again.
    """
    if call is None:
        return df.withColumn(out_col, F.lit(None).cast("string"))
    wait, book = before * (in_flight or 1), Journal(journal) if journal else None

    def one(m, known: dict, keep) -> str | None:
        if m is None:
            return None
        messages = [{"role": x["role"], "content": x["content"]} for x in m]
        key = hashlib.sha256(json.dumps(messages).encode()).hexdigest()
        if key in known:
            return known[key]
        try:
            said = with_retry(lambda: call(messages), retries, pause, wait)
        except Exception:  # noqa: BLE001  a client's own errors are of any kind; the caller decides what a failure means
            return None
        keep(key, said)
        return said

    @F.pandas_udf("string")
    def ask(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        task = TaskContext.get()
        known, keep = book.open(task.partitionId(), task.taskAttemptId()) if book else ({}, lambda key, said: None)
        for col in columns:
            yield col.map(lambda m: one(m, known, keep))

    rows = df.repartition(in_flight, messages_col) if in_flight else df
    return rows.withColumn(out_col, ask.asNondeterministic()(F.col(messages_col)))


def as_json(reply: object) -> str:
    """A reply given as an object of any class, as JSON text."""
    return json.dumps(reply, ensure_ascii=False, default=lambda o: o.model_dump() if hasattr(o, "model_dump") else vars(o) if hasattr(o, "__dict__") else str(o))


def judge(df: DataFrame, call: Callable[[str], object], prompt_col: str = "prompt", out_col: str = "verdict", retries: int = 3, pause: float = 5.0, before: float = 0.0) -> DataFrame:
    """df with each prompt's verdict and the text that it was read from.

    A call returns a text, or a reply as an object whose text is looked for. Calling is all that Python does; replies are
    read by expressions. Rows whose reply can't be read are asked again, up to `retries` times; in the end it is an error.
    """

    @F.pandas_udf("struct<said:string,whole:boolean>")
    def ask(prompts: pd.Series) -> pd.DataFrame:
        replies = [None if pd.isna(p) else with_retry(lambda: call(p), retries, pause, before) for p in prompts]
        return pd.DataFrame({"said": [r if r is None or isinstance(r, str) else as_json(r) for r in replies], "whole": [isinstance(r, str) for r in replies]})

    rows, texts, found, todo = df, [], [], F.col(prompt_col)
    for k in range(retries + 1):
        reply = F.col(f"_reply{k}")
        text = F.when(reply["whole"], reply["said"]).otherwise(reply_text(reply["said"]))
        rows = rows.withColumn(f"_reply{k}", ask.asNondeterministic()(todo)).withColumn(f"_text{k}", text).withColumn(f"_found{k}", verdict(F.col(f"_text{k}")))
        texts.append(F.col(f"_text{k}"))
        found.append(F.col(f"_found{k}"))
        todo = F.when(F.coalesce(*found).isNull(), F.col(prompt_col))
    first = F.coalesce(*[F.when(v.isNotNull(), F.struct(v.alias("v"), t.alias("t"))) for v, t in zip(found, texts)])
    unread = F.raise_error(F.concat(F.lit("the judge's reply can't be read: "), F.substring(F.coalesce(texts[-1], F.lit("null")), 1, 300)))
    names = [x.split(":")[0] for x in VERDICT[len("struct<") : -1].split(",")]
    out = F.when(first.isNotNull(), F.struct(*[first["v"][n].alias(n) for n in names], first["t"].alias("raw_response"))).otherwise(unread)
    return rows.withColumn(out_col, out).drop(*[f"_{c}{k}" for c in ("reply", "text", "found") for k in range(retries + 1)])


class RecordedJudge:
    """Verdicts recorded earlier as JSON texts, by question: a table (question, verdict) that prompts are joined with.

    Of several verdicts of a question the first in order counts; without one nothing was said, which is an empty verdict.
    """

    def __init__(self, verdicts: DataFrame):
        self.verdicts = verdicts

    def join(self, df: DataFrame, question_col: str) -> DataFrame:
        """df with _said, the verdict recorded for its question."""
        one = self.verdicts.groupBy(F.col("question").alias("_asked")).agg(F.min("verdict").alias("_said"))
        return df.join(one, F.col(question_col) == F.col("_asked"), "left").drop("_asked").withColumn("_said", F.coalesce("_said", F.lit("{}")))


def recorded_verdicts(df: DataFrame, judge: RecordedJudge, question_col: str = "question", out_col: str = "verdict") -> DataFrame:
    """judge() with recorded verdicts: no one is asked. One that can't be read is an error."""
    said = judge.join(df, question_col)
    found = verdict(F.col("_said"))
    unread = F.raise_error(F.concat(F.lit("the judge's reply can't be read: "), F.substring("_said", 1, 300)))
    names = [x.split(":")[0] for x in VERDICT[len("struct<") : -1].split(",")]
    return said.withColumn("_found", found).withColumn(out_col, F.when(F.col("_found").isNotNull(), F.struct(*[F.col("_found")[n].alias(n) for n in names], F.col("_said").alias("raw_response"))).otherwise(unread)).drop("_said", "_found")
