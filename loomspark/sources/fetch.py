"""Landing remote records: downloads with retries, a disk cache and pages that may come short."""

from __future__ import annotations

import json
import re
import shutil
import time
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any
from urllib.error import HTTPError
from urllib.request import Request, urlopen

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession


def with_retries(get: Callable[[], Any], tries: int = 4, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Any:
    """The result of `get`, tried again after waits that double; the last failure is raised."""
    for k in range(tries):
        try:
            return get()
        except OSError:
            if k == tries - 1:
                raise
            sleep(wait * 2**k)
    raise ValueError("at least one try is needed")


def download(url: str, path: str | Path, tries: int = 4, wait: float = 1.0, timeout: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> Path:
    """The file behind an address, written in pieces beside its place and moved there once it is whole.

    A refusal of the server (4xx) is raised at once, all other failures are tried again. An archive of one file is unpacked by `unpacked`.
    """
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f"{path.name}.part")

    def get() -> Path:
        try:
            with urlopen(Request(url, headers={"User-Agent": "loomspark"}), timeout=timeout) as source, part.open("wb") as to:
                shutil.copyfileobj(source, to)
        except HTTPError as refused:
            if refused.code < 500:
                raise ValueError(f"{url}: {refused.code}") from refused
            raise
        return part.replace(path)

    return with_retries(get, tries, wait, sleep)


def unpacked(path: str | Path, folder: str | Path) -> list[Path]:
    """The files of a zip archive, none of them outside of the folder."""
    out = []
    with zipfile.ZipFile(path) as z:
        for name in z.namelist():
            if not name.endswith("/"):
                out.append(Path(z.extract(name, folder)))
    return out


def get_json(url: str, timeout: float = 60.0) -> Any:
    """What an address answers, as JSON."""
    with urlopen(Request(url, headers={"Accept": "application/json", "User-Agent": "loomspark"}), timeout=timeout) as source:
        return json.load(source)


def cached(folder: str | Path, key: str, get: Callable[[], Any], delay: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> Any:
    """What a file of the folder holds under the key, or else what `get` gives; only a real fetch is followed by a delay."""
    path = Path(folder) / f"{re.sub(r'[^0-9A-Za-z_-]', '_', key)}.json"
    if path.exists():
        return json.loads(path.read_text(encoding="utf-8"))
    found = get()
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_suffix(".part")
    part.write_text(json.dumps(found), encoding="utf-8")
    part.replace(path)
    sleep(delay)
    return found


def shared_cached(spark: SparkSession, folder: str, key: str, get: Callable[[], Any], delay: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> Any:
    """`cached` in a folder of any file system that Spark writes to, as the shared one of a cluster."""
    path = f"{folder}/{re.sub(r'[^0-9A-Za-z_-]', '_', key)}.json"
    try:
        return json.loads(spark.read.text(path).first()["value"])
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    found = get()
    spark.createDataFrame([(json.dumps(found),)], "value string").coalesce(1).write.text(path)
    sleep(delay)
    return found


def pages(page: Callable[[int], list], size: int, wait: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> Iterator[list]:
    """Pages from 1 on until one is empty or short twice; a short one is asked for again and the longer answer kept."""
    number = 1
    while True:
        rows = page(number)
        if len(rows) < size:
            sleep(wait)
            rows = max(rows, page(number), key=len)
        if rows:
            yield rows
        if len(rows) < size:
            return
        number += 1


def expected_count(html: str) -> int | None:
    """The count that a page states; None only where it says that there are none; anything else is an error."""
    if m := re.search(r"Found\s+([\d,]+)\s+performances?", html):
        return int(m[1].replace(",", ""))
    if re.search(r"No performances (?:were )?found", html, re.I):
        return None
    raise ValueError("the page states no count")
