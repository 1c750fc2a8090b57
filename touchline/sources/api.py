"""The REST source as a Python data source: requests in lanes that share the service's allowance."""

from __future__ import annotations

import io
import itertools
import json
import time
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from touchline import files
from touchline.session import shuffle_parts

#: How the service is asked.
TIMEOUT_S, ATTEMPTS, BACKOFF_CAP_S, IDS_PER_REQUEST = 10, 5, 60, 20
#: Recorded answers of an endpoint that may be a file each, and answers in a pack where there are more.
SINGLE, PACKED = 1000, 64
#: What is left for the day and for the minute, as the service tells in its headers.
_DAY, _MINUTE = "x-ratelimit-requests-remaining", "x-ratelimit-remaining"


class Transient(Exception):
    """A failure that may pass: connection lost, time out, server error."""


class Failed(Exception):
    """A request without an answer: refused, unreadable or given up."""


def _utc() -> datetime:
    return datetime.now(timezone.utc)


@dataclass
class Pace:
    """When the next request of a lane may go out, from what the answers so far told.

    ``lanes`` ask at the same time, so a lane stops when fewer requests are left than there are
    lanes. A minute's allowance comes back, so it is waited for; a day's doesn't in the time of a
    task, so what is left of a lane fails at once and can be asked again the next day.
    """

    lanes: int = 1
    sleep: Callable = time.sleep
    now: Callable = _utc
    _pause: float = field(default=0, init=False)
    _spent_on: object = field(default=None, init=False)

    def before(self) -> None:
        if self._spent_on == self.now().date():
            raise Failed("the allowance of the day is spent")
        pause, self._pause = self._pause, 0
        if pause:
            self.sleep(pause)

    def after(self, headers: dict) -> None:
        def left(name: str) -> float:
            text = str(headers.get(name, "")).strip()
            return int(text) if text.isdigit() else float("inf")

        if left(_DAY) < self.lanes:
            self._spent_on = self.now().date()
        if left(_MINUTE) < self.lanes:
            self.rest(60)

    def rest(self, seconds: float) -> None:
        self._pause = max(self._pause, seconds)


def _items(text: str) -> list:
    try:
        document = json.loads(text)
    except ValueError as e:
        raise Failed("the answer is no JSON document") from e
    if not isinstance(document, dict):
        raise Failed("the answer is no JSON object")
    return document.get("response", [])


def require_response(fetch: Callable, endpoint: str, params: dict, pace: Pace | None = None) -> list:
    """The ``response`` list of one request; ``Failed`` when it is refused, unreadable, or all attempts fail.

    ``fetch(endpoint, params, timeout)`` gives (status, headers, text). A good answer counts
    whatever its headers say of the allowance; the next request pays for that.
    """
    pace, why = pace or Pace(), ""
    for attempt in range(ATTEMPTS):
        pace.before()
        pause = min(2**attempt, BACKOFF_CAP_S)
        try:
            status, headers, text = fetch(endpoint, params, TIMEOUT_S)
        except Transient as e:
            why = f"no connection {e}".strip()
        else:
            pace.after(headers)
            if status < 400:
                return _items(text)
            if status < 500 and status != 429:
                raise Failed(f"refused with status {status}")
            why = f"status {status}"
            told = str(headers.get("Retry-After", ""))
            pause = int(told) if status == 429 and told.isdigit() else pause
        pace.rest(pause)
    raise Failed(f"{ATTEMPTS} attempts, the last with {why}")


def http_fetch(base: str, headers: dict[str, str]) -> Callable:
    """A transport over the standard library."""

    def fetch(endpoint: str, params: dict, timeout: int):
        import urllib.error
        import urllib.parse
        import urllib.request

        request = urllib.request.Request(f"{base}{endpoint}?{urllib.parse.urlencode(params)}", headers=headers)
        try:
            with urllib.request.urlopen(request, timeout=timeout) as r:
                return r.status, dict(r.headers), r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, dict(e.headers), ""
        except OSError as e:
            raise Transient(str(e)) from e

    return fetch


def answer_name(params: dict) -> str:
    """The name of a recorded answer: its parameters in order."""
    return "_".join(f"{k}-{params[k]}" for k in sorted(params))


def folder_fetch(root: str) -> Callable:
    """An offline transport: the answer to a request is a JSON file named by its sorted parameters, alone or in a pack.

    An answer with ``same_as`` is that of another name.
    """
    packs: dict[str, int] = {}

    def fetch(endpoint: str, params: dict, timeout: int):
        from touchline.files import arrow_system

        system, base = arrow_system(root)
        at = f"{base}/{endpoint.strip('/')}"
        if at not in packs:
            try:
                with system.open_input_stream(f"{at}.packs") as f:
                    packs[at] = int(f.read())
            except FileNotFoundError:
                packs[at] = 0

        def read(name: str) -> str:
            if not packs[at]:
                with system.open_input_stream(f"{at}/{name}.json") as f:
                    return f.read().decode()
            with system.open_input_file(f"{at}/{zlib.crc32(name.encode()) % packs[at]}.zip") as f, zipfile.ZipFile(f) as pack:
                return pack.read(f"{name}.json").decode()

        try:
            text = read(answer_name(params))
            other = json.loads(text).get("same_as") if '"same_as"' in text else None
            return 200, {}, read(other) if other else text
        except (FileNotFoundError, KeyError):
            return 404, {}, ""

    return fetch


def plan_packs(spark: SparkSession, folder: str, endpoint: str, number: int) -> None:
    """Settle, before ``number`` answers of an endpoint are recorded, whether ``folder`` holds them in packs.

    The smallest file takes a block of disk, so that many short answers take several times their size.
    """
    if number > SINGLE:
        files.write_text(spark, f"{folder}/{endpoint}.packs", str(-(-number // PACKED)))


def planned_packs(spark: SparkSession, folder: str, endpoint: str) -> int:
    """The number of packs that ``plan_packs`` settled, 0 where answers are a file each."""
    return int(files.read_text(spark, f"{folder}/{endpoint}.packs") or 0)


def pack_answers(answers: DataFrame, folder: str, endpoint: str, packs: int) -> int:
    """Write answers (name, body strings) to their packs, zip archives, for ``folder_fetch``; their number."""

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from touchline.files import arrow_system

        system, base = arrow_system(folder)
        system.create_dir(f"{base}/{endpoint}", recursive=True)
        rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(3))))
        for pack, own in itertools.groupby(rows, lambda row: row[0]):
            packed, n = io.BytesIO(), 0
            with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
                for _, name, body in own:
                    archive.writestr(f"{name}.json", body)
                    n += 1
            with system.open_output_stream(f"{base}/{endpoint}/{pack}.zip") as f:
                f.write(packed.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    home = F.pmod(F.crc32("name"), F.lit(packs)).cast("long").alias("pack")
    held = answers.select(home, "name", "body").repartition(shuffle_parts(answers.sparkSession), "pack").sortWithinPartitions("pack")
    return sum(r.n for r in held.mapInArrow(write, "n bigint").collect())


def record_answers(answers: DataFrame, folder: str) -> int:
    """Write answers (endpoint, name, body strings) as files for ``folder_fetch``, each by the task that holds it; their number."""

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from touchline.files import arrow_system

        system, base = arrow_system(folder)
        for batch in batches:
            for endpoint, name, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                system.create_dir(f"{base}/{endpoint}", recursive=True)
                with system.open_output_stream(f"{base}/{endpoint}/{name}.json") as f:
                    f.write(body.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return sum(r.n for r in answers.select("endpoint", "name", "body").mapInArrow(write, "n bigint").collect())


def batches_of_ids(ids: list) -> list[dict]:
    """Requests for ids, twenty each, joined by hyphens."""
    return [{"ids": "-".join(map(str, ids[i : i + IDS_PER_REQUEST]))} for i in range(0, len(ids), IDS_PER_REQUEST)]


class _Lane(InputPartition):
    def __init__(self, requests: list[dict]) -> None:
        self.requests = requests


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        self.lanes = max(1, int(options.get("lanes", "1")))

    def partitions(self) -> list[InputPartition]:
        requests = json.loads(self.options["requests"])
        lanes = [requests[i :: self.lanes] for i in range(self.lanes)]
        return [_Lane(own) for own in lanes if own] or [_Lane([])]

    def read(self, partition: _Lane) -> Iterator[tuple]:
        o = self.options
        fetch = folder_fetch(o["folder"]) if o.get("folder") else http_fetch(o["base"], json.loads(o.get("headers", "{}")))
        pace = Pace(self.lanes)
        for request in partition.requests:
            params = json.dumps(request, sort_keys=True)
            try:
                for item in require_response(fetch, o["endpoint"], request, pace):
                    yield params, json.dumps(item), None
            except Exception as e:  # a failed unit is recorded; the others go on
                yield params, None, f"{type(e).__name__}: {e}"


class ApiDataSource(DataSource):
    """Format ``football_api``: rows (request, body, error), a partition for each lane of requests."""

    @classmethod
    def name(cls) -> str:
        return "football_api"

    def schema(self) -> str:
        return "request string, body string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_api(spark: SparkSession, endpoint: str, requests: list[dict], **options: str) -> DataFrame:
    """Responses of many requests: (request, body, error); parse bodies with ``from_json``.

    ``requests`` hold what the service offers: league and season, from and to dates, ids, last or
    next n. Options: ``base`` and ``headers`` for HTTP, or ``folder`` for recorded answers, and
    ``lanes``, how many tasks ask at the same time. All requests of a lane, and so with one lane all
    there are, keep to one view of the allowance.
    """
    spark.dataSource.register(ApiDataSource)
    return spark.read.format("football_api").options(endpoint=endpoint, requests=json.dumps(requests), **options).load()
