"""Request shaping for chat providers: what is sent and what is read from an answer. Nothing here opens a connection."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from lexgrove.operators.sampling import hash_text
from lexgrove.sources.config import ProviderSettings


class ProviderFault(Exception):
    """A request that can't be shaped or sent."""


def extra_body(s: ProviderSettings) -> dict[str, Any]:
    """What an adapter adds to the body of a request: each has its own way to switch thinking."""
    on = s.thinking == "on"
    kind = {"type": "enabled" if on else "disabled"}
    shapes = {
        "zhipu_thinking_body": {"thinking": kind, "clear_thinking": True}, "deepseek_reasoning_effort": {"thinking": kind}, "aliyun_enable_thinking": {"enable_thinking": on},
        "nvidia_gemma_chat_template": {"chat_template_kwargs": {"enable_thinking": on}, "include_reasoning": s.save_reasoning and on},
        "vllm_gemma_chat_template": {"chat_template_kwargs": {"enable_thinking": on}}, "openai_reasoning_effort": {}, "plain_openai": {},
    }
    if s.request_adapter not in shapes:
        raise ProviderFault(f"unknown request_adapter: {s.request_adapter}")
    return shapes[s.request_adapter]


def request_body(s: ProviderSettings, messages: list[dict[str, str]]) -> dict[str, Any]:
    """All that a request holds; an effort only where the adapter knows it and thinking is on."""
    out = {"model": s.model, "messages": messages, "temperature": s.temperature, "top_p": s.top_p, "max_tokens": s.max_answer_tokens, "extra_body": extra_body(s)}
    if s.request_adapter in ("deepseek_reasoning_effort", "openai_reasoning_effort") and s.thinking == "on" and s.reasoning_effort:
        out["reasoning_effort"] = s.reasoning_effort
    return out


def answer_fields(message: dict[str, Any], limit: int) -> dict[str, Any]:
    """Text and reasoning of an answer's message, the reasoning cut at ``limit`` characters; two names for it are in use."""
    reasoning = message.get("reasoning_content")
    if reasoning is None:
        reasoning = message.get("reasoning")
    reasoning = None if reasoning is None else str(reasoning)
    cut = bool(reasoning) and len(reasoning) > limit
    return {
        "final_answer_text": message.get("content") or "", "reasoning_text": reasoning[:limit] if cut else reasoning,
        "reasoning_available": bool(reasoning), "reasoning_truncated": cut,
    }


def messages_of(request: dict[str, Any]) -> list[dict[str, str]]:
    payload = request.get("messages")
    if payload:
        return [dict(m) if isinstance(m, dict) else {"role": m["role"], "content": m["content"]} for m in payload]
    return [{"role": "system", "content": request["system_prompt"]}, {"role": "user", "content": request["prompt"]}]


class ChatProvider:
    """Any provider behind a function that takes a request's body and gives the answer as a dictionary."""

    def __init__(self, settings: ProviderSettings, send: Callable[[dict[str, Any]], dict[str, Any]]) -> None:
        self.settings, self.send = settings, send

    def call(self, request: dict[str, Any], attempt: int) -> dict[str, Any]:
        """An answer as a response row. Errors are rows too, with their kind and text, and never raised."""
        s = self.settings
        sent = {"protocol": s.protocol, "base_url": s.base_url, "model": s.model, "request_adapter": s.request_adapter, "thinking": s.thinking, "reasoning_effort": s.reasoning_effort, "save_reasoning": s.save_reasoning, "temperature": s.temperature, "top_p": s.top_p, "max_answer_tokens": s.max_answer_tokens}
        row = {
            "attempt_id": f"attempt_{hash_text({'request_id': request['request_id'], 'attempt': attempt})}", "provider": s.name, "model": s.model, "final_answer_text": "", "reasoning_text": None,
            "answer_truncated": False, "reasoning_truncated": False, "reasoning_available": False, "actual_request_parameters": sent, "raw_response": None,
        }
        try:
            raw = self.send(request_body(s, messages_of(request)))
            got = answer_fields(raw["choices"][0]["message"], s.reasoning_char_limit)
        except Exception as e:  # noqa: BLE001  a provider's failure is data
            return row | {"status": "error", "error_state": f"{type(e).__name__}: {e}"}
        if not s.save_reasoning:
            got["reasoning_text"] = None
        return row | got | {"status": "success", "error_state": None, "raw_response": raw}


class MockProvider:
    """Answers with the gold answer: a list for T2, else True or False; in mode ``empty`` with nothing."""

    def __init__(self, mode: str = "gold") -> None:
        self.mode = mode

    def call(self, request: dict[str, Any], attempt: int) -> dict[str, Any]:
        if self.mode == "empty":
            said = ""
        elif request["task"] == "T2":
            said = str([int(x) for x in request["gold_set"]])
        else:
            said = str(bool(request.get("gold_bool")))
        raw = {"mock": True, "content": said, "reasoning_content": "mock reasoning"}
        return {
            "attempt_id": f"attempt_{hash_text({'request_id': request['request_id'], 'attempt': attempt})}", "status": "success", "provider": "mock", "model": "mock", "final_answer_text": said,
            "reasoning_text": "mock reasoning", "reasoning_available": True, "reasoning_truncated": False, "answer_truncated": False, "error_state": None, "raw_response": raw,
            "actual_request_parameters": {"provider": "mock", "mode": self.mode},
        }
