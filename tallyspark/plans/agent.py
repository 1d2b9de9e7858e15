"""A tool-using agent on the driver: a decision hook, a limit of steps, a summary, events and a history by session."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

Message = dict[str, Any]
#: Steps of a question at most, and messages of a session that a decision sees.
MOST_STEPS, HISTORY = 8, 20
#: Replies of a service that are worth another try.
PASSING_FAULTS = (429, 500, 502, 503, 504)


class ServiceFault(Exception):
    """A language model's service answered with this status."""

    def __init__(self, status: int) -> None:
        super().__init__(f"status {status}")
        self.status = status


def patient(call: Callable[..., Any], tries: int = 3, pause: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Callable[..., Any]:
    """The call, tried again after passing faults with longer and longer pauses; None when it fails all the same."""

    def run(*args: Any, **named: Any) -> Any:
        for n in range(1, tries + 1):
            try:
                return call(*args, **named)
            except ServiceFault as e:
                if e.status not in PASSING_FAULTS or n == tries:
                    return None
                sleep(pause * n)
            except Exception:  # noqa: BLE001  whatever a service raises, the caller has another way
                return None
        return None

    return run


@dataclass
class Agent:
    """``decide`` gets the messages and returns ``{"tool", "arguments"}`` or ``{"answer"}``; ``summarise`` ends a question that doesn't end by itself."""

    tools: dict[str, Callable[..., Any]]
    decide: Callable[[list[Message]], dict[str, Any] | None]
    summarise: Callable[[list[Message]], str | None]
    otherwise: Callable[[str], str] | None = None
    most: int = MOST_STEPS
    sessions: dict[str, list[Message]] = field(default_factory=dict)

    def use(self, step: int, name: str, arguments: dict[str, Any]) -> dict[str, Any]:
        began = time.perf_counter()
        tool = self.tools.get(name)
        try:
            outcome = {"error": f"unknown tool: {name}"} if tool is None else tool(**arguments)
        except Exception as e:  # noqa: BLE001  a failing tool is an observation
            outcome = {"error": str(e)}
        status = "error" if isinstance(outcome, dict) and "error" in outcome else "ok"
        return {"step": step, "tool": name, "arguments": arguments, "status": status, "result": outcome, "seconds": round(time.perf_counter() - began, 3)}

    def stream(self, question: str, session: str | None = None) -> Iterator[dict[str, Any]]:
        """Events ``thinking, tool_start, step, summarizing`` and at last one ``result`` or ``error``."""
        history = list(self.sessions.get(session, [])) if session else []
        messages = [*history[-HISTORY:], {"role": "user", "content": question}]
        trace: list[dict[str, Any]] = []
        answer, status = None, "answered"
        for step in range(1, self.most + 1):
            yield {"event": "thinking", "step": step}
            move = self.decide(messages)
            if not isinstance(move, dict):
                status = "fallback"
                break
            if "answer" in move:
                answer = str(move["answer"])
                break
            name, arguments = str(move.get("tool")), move.get("arguments")
            arguments = arguments if isinstance(arguments, dict) else {}
            yield {"event": "tool_start", "step": step, "tool": name, "arguments": arguments}
            entry = self.use(step, name, arguments)
            trace.append(entry)
            messages.append({"role": "tool", "tool": name, "content": entry["result"]})
            yield {"event": "step", **entry}
        else:
            status = "limit"
        if answer is None and status != "fallback" or (status == "fallback" and trace):
            yield {"event": "summarizing", "steps": len(trace)}
            answer = self.summarise(messages)
        if not answer and self.otherwise is not None:
            answer, status = self.otherwise(question), "fallback"
        if not answer:
            yield {"event": "error", "error": "no answer", "trace": trace}
            return
        if session:
            self.sessions[session] = [*history, {"role": "user", "content": question}, {"role": "assistant", "content": answer}]
        yield {"event": "result", "status": status, "answer": answer, "trace": trace}

    def run(self, question: str, session: str | None = None) -> dict[str, Any]:
        """The last event."""
        *_, last = self.stream(question, session)
        return last
