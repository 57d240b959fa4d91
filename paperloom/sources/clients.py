"""Models behind a service that answers prompts over HTTP, and the settings that name it.

Settings come from the session (spark.paperloom.…) and, where it says nothing, from the environment (PAPERLOOM_…). A key is never
written in code, and the plan that Spark ships holds it only where it was given; otherwise each worker reads its own. A service is
opened on the worker that first asks it, once a process and key, and holds the number of requests at a time to a bound."""

from __future__ import annotations

import json
import os
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

from paperloom.sources.providers import Fallback, Unavailable

PREFIX, ENVIRONMENT = "spark.paperloom.", "PAPERLOOM_"
RETRIED = (429, 500, 502, 503, 504)


class MissingKey(Unavailable):
    """No key for the service is configured."""


@dataclass(frozen=True)
class Settings:
    """url of the service; models in the order in which they are tried; key; requests at a time in a worker; seconds and tries of a
    request; pins by role."""

    url: str = ""
    models: tuple[str, ...] = ()
    key: str | None = field(default=None, repr=False)
    concurrency: int = 4
    timeout: float = 60.0
    tries: int = 3
    pins: tuple[tuple[str, str], ...] = field(default=(), repr=False)

    @classmethod
    def load(cls, spark: SparkSession | None = None, environ: Mapping[str, str] | None = None) -> Settings:
        """model.url, model.names (comma-separated), model.key, model.concurrency, model.timeout, model.tries, and pin.<role>."""
        environ = os.environ if environ is None else environ
        said = {k.removeprefix(PREFIX): v for k, v in (spark.conf.getAll if spark is not None else {}).items() if k.startswith(PREFIX)}

        def get(name: str, other: str) -> str:
            return (said.get(name) or environ.get(ENVIRONMENT + name.upper().replace(".", "_")) or other).strip()

        pins = {k.removeprefix(f"{ENVIRONMENT}PIN_").lower(): v for k, v in environ.items() if k.startswith(f"{ENVIRONMENT}PIN_")}
        pins |= {k.removeprefix("pin.").lower(): v for k, v in said.items() if k.startswith("pin.")}
        return cls(
            get("model.url", ""),
            tuple(m.strip() for m in get("model.names", "").split(",") if m.strip()),
            get("model.key", "") or None,
            int(get("model.concurrency", "4")),
            float(get("model.timeout", "60")),
            int(get("model.tries", "3")),
            tuple(sorted(pins.items())),
        )


class Service:
    """A service that is opened: sends {"model", "prompt"} as JSON, with the key as bearer, and reads {"text"}. At most `concurrency`
    requests are under way; one that is refused for now is sent again after the time that the service asks for, or a growing pause."""

    def __init__(self, settings: Settings, key: str):
        self.settings, self.key = settings, key
        self.gate = threading.BoundedSemaphore(settings.concurrency)

    def ask(self, model: str, prompt: str) -> str:
        s = self.settings
        body = json.dumps({"model": model, "prompt": prompt}).encode()
        request = urllib.request.Request(s.url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        for left in range(s.tries - 1, -1, -1):
            try:
                with self.gate, urllib.request.urlopen(request, timeout=s.timeout) as answer:
                    return str(json.load(answer).get("text") or "")
            except urllib.error.HTTPError as error:
                if error.code not in RETRIED or not left:
                    raise
                after = error.headers.get("Retry-After", "")
                pause = float(after) if after.replace(".", "", 1).isdigit() else 0.5 * 2 ** (s.tries - 1 - left)
            except (urllib.error.URLError, TimeoutError):
                if not left:
                    raise
                pause = 0.5 * 2 ** (s.tries - 1 - left)
            time.sleep(min(pause, s.timeout))
        raise Unavailable("a service is asked at least once")


_opened: dict[Any, Service] = {}
_lock = threading.Lock()


def opened(settings: Settings) -> Service:
    """The service of these settings, opened once in a process; MissingKey where neither they nor the environment have a key."""
    key = settings.key or os.environ.get(f"{ENVIRONMENT}MODEL_KEY", "").strip()
    if not settings.url or not key:
        raise MissingKey("set spark.paperloom.model.url and spark.paperloom.model.key, or PAPERLOOM_MODEL_URL and PAPERLOOM_MODEL_KEY")
    with _lock:
        if (settings, key) not in _opened:
            _opened[settings, key] = Service(settings, key)
        return _opened[settings, key]


@dataclass(frozen=True)
class ServiceModel:
    """One model of a service. What is shipped to workers are settings; the service is opened there, when it is first asked."""

    settings: Settings
    name: str

    def complete(self, prompt: str) -> str:
        return opened(self.settings).ask(self.name, prompt)


def model_of(settings: Settings, pause: float = 0.5) -> Fallback:
    """The models of a service in order, each tried where the one before fails or says nothing. Without a key it fails here, not on a
    worker after hours."""
    if not settings.models:
        raise Unavailable("no model is named: set spark.paperloom.model.names")
    opened(settings)
    return Fallback([ServiceModel(settings, name) for name in settings.models], pause)
