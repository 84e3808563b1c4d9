"""Where replies come from: recorded ones, rules, and HTTP services behind an injected transport."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import js
from ..functions.envelope import _texts
from ..program import request_hash

EMPTY_REPLY = '{"extractions":[]}'


class ProviderError(Exception):
    """kind: transient (another attempt may help) or permanent."""

    def __init__(self, message: str, kind: str = "permanent", code: str = "provider_error", status: int | None = None):
        super().__init__(message)
        self.kind, self.code, self.status = kind, code, status


def kind_of_status(status: int) -> str:
    return "transient" if status in (408, 429) or status >= 500 else "permanent"


def is_transient(error: BaseException) -> bool:
    return isinstance(error, ProviderError) and error.kind == "transient" or getattr(error, "transient", False) is True


@dataclass
class Reply:
    text: str
    channel: str = "text"
    record: dict = field(default_factory=dict)


class Provider:
    """Answers requests.  ``structured`` is called if the request has a schema.  Instances travel to
    the executors, so they hold plain values and functions only."""

    name = "provider"

    def plain(self, request: dict) -> Reply:
        raise NotImplementedError

    def structured(self, request: dict) -> Reply:
        return self.plain(request)

    def answer(self, request: dict) -> Reply:
        reply = self.structured(request) if request.get("schema") is not None else self.plain(request)
        reply.record = {"provider": self.name, "model": request.get("model"), "request_hash": request_hash(request), "channel": reply.channel} | reply.record
        return reply


@dataclass
class ReplayProvider(Provider):
    """Recorded replies by request hash.  Structured requests fall back to plain recordings, then to
    the default.  For many recordings use :func:`replay`, a join."""

    plain_replies: dict[str, str] = field(default_factory=dict)
    structured_replies: dict[str, str] = field(default_factory=dict)
    default: str = EMPTY_REPLY
    structured_default: str | None = None
    name = "replay"

    def plain(self, request):
        return Reply(self.plain_replies.get(request_hash(request), self.default))

    def structured(self, request):
        key = request_hash(request)
        fallback = self.plain_replies.get(key, self.default if self.structured_default is None else self.structured_default)
        return Reply(self.structured_replies.get(key, fallback), "structured")


@dataclass
class RuleProvider(Provider):
    """Replies computed from the prompt by a function."""

    rule: Callable[[dict], str]
    name = "rule"

    def plain(self, request):
        return Reply(self.rule(request))


def replay(requests: DataFrame, recorded: DataFrame, default: str = EMPTY_REPLY) -> DataFrame:
    """``requests`` (request_hash, ...) with the reply recorded for each: the structured one, else
    the plain one, else the default.  recorded: request_hash, channel, text."""
    by = recorded.groupBy("request_hash").agg(F.max(F.when(F.col("channel") == "structured", F.col("text"))).alias("s"), F.max(F.when(F.col("channel") == "text", F.col("text"))).alias("p"))
    return requests.join(by, "request_hash", "left").withColumn("reply", F.coalesce("s", "p", F.lit(default))).drop("s", "p")


# ---------------------------------------------------------------- HTTP services

#: transport(url, headers, body) -> (status, text)
Transport = Callable[[str, dict, str], tuple[int, str]]


@dataclass
class HttpProvider(Provider):
    base_url: str
    api_key: str | None = None
    transport: Transport | None = None

    def _post(self, path: str, headers: dict, body: dict) -> Any:
        if self.transport is None:
            raise ProviderError("no transport was given", code="unsupported_runtime")
        try:
            status, text = self.transport(self.base_url.rstrip("/") + path, {"content-type": "application/json"} | headers, json.dumps(body, ensure_ascii=False))
        except ProviderError:
            raise
        except Exception as e:
            raise ProviderError(str(e), "transient", "network_error") from e
        if not 200 <= status < 300:
            raise ProviderError(f"{self.name} answered with status {status}.", kind_of_status(status), "http_error", status)
        try:
            return js.loads(text)
        except ValueError as e:
            raise ProviderError(f"{self.name} answered with no JSON.", code="parse_error") from e

    def _reply(self, calls, content) -> Reply:
        """The first tool call's arguments, if it has any, else the text."""
        for given in calls:
            if isinstance(given, str) and js.trim(given):
                return Reply(given, "tool_call")
            if isinstance(given, (dict, list)):
                return Reply(js.dumps(given), "tool_call")
        if not isinstance(content, str):
            raise ProviderError(f"{self.name} answered in an unknown shape.", code="parse_error")
        return Reply(content)


def _calls(message) -> list:
    calls = js.get(message, "tool_calls")
    return [js.get(js.get(c, "function"), "arguments") for c in (calls if isinstance(calls, list) else [])]


class ChatProvider(HttpProvider):
    """Chat completions with a bearer key; a schema is sent as a strict response format."""

    name = "chat"

    def plain(self, request):
        body = {"model": request["model"], "messages": [{"role": "user", "content": request["prompt"]}]}
        if request.get("schema") is not None:
            body["response_format"] = {"type": "json_schema", "json_schema": {"name": "extraction_payload", "strict": True, "schema": request["schema"]}}
        out = self._post("/chat/completions", {"authorization": f"Bearer {self.api_key}"}, body)
        choices = js.get(out, "choices")
        message = js.get(choices[0], "message") if isinstance(choices, list) and choices else js.MISSING
        content = js.get(message, "content")
        return self._reply(_calls(message), _texts(content) if isinstance(content, (str, list)) else None)


class GenerateProvider(HttpProvider):
    """A ``generateContent`` service; the key goes with the URL."""

    name = "generate"

    def plain(self, request):
        body: dict = {"contents": [{"role": "user", "parts": [{"text": request["prompt"]}]}]}
        if request.get("schema") is not None:
            body["generationConfig"] = {"responseMimeType": "application/json", "responseSchema": request["schema"]}
        out = self._post(f"/models/{request['model']}:generateContent?key={self.api_key}", {}, body)
        options = js.get(out, "candidates")
        parts = js.get(js.get(options[0], "content"), "parts") if isinstance(options, list) and options else js.MISSING
        if not isinstance(parts, list):
            raise ProviderError(f"{self.name} answered in an unknown shape.", code="parse_error")
        told = [t for p in parts if isinstance(t := js.get(p, "text"), str)]
        return self._reply([js.get(js.get(p, "functionCall"), "args") for p in parts], "\n".join(told) if told else None)


class LocalChatProvider(HttpProvider):
    """A local chat service that answers in one piece; ``format`` is the schema, or json."""

    name = "local-chat"

    def plain(self, request):
        schema = request.get("schema")
        body = {"model": request["model"], "stream": False, "format": schema if schema is not None else "json", "messages": [{"role": "user", "content": request["prompt"]}]}
        message = js.get(self._post("/api/chat", {}, body), "message")
        return self._reply(_calls(message), js.get(message, "content"))
