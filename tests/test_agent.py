import pytest

from tallyspark.plans.agent import HISTORY, Agent, ServiceFault, patient


def plan(*moves):
    left = list(moves)
    return lambda messages: left.pop(0)


def test_a_question_ends_with_an_answer_and_its_trace():
    agent = Agent({"add": lambda a, b: {"sum": a + b}}, plan({"tool": "add", "arguments": {"a": 1, "b": 2}}, {"tool": "nope"}, {"tool": "add", "arguments": 5}, {"answer": "three"}), lambda m: "summary")
    events = list(agent.stream("q", "s"))
    assert [e["event"] for e in events] == ["thinking", "tool_start", "step"] * 3 + ["thinking", "result"]
    assert [(t["status"], t["tool"]) for t in events[-1]["trace"]] == [("ok", "add"), ("error", "nope"), ("error", "add")]
    assert events[-1]["answer"] == "three" and [m["role"] for m in agent.sessions["s"]] == ["user", "assistant"]


def test_the_limit_of_steps_forces_a_summary():
    seen = []
    agent = Agent({"t": lambda: 1}, lambda messages: {"tool": "t"}, lambda messages: seen.append(len(messages)) or "so far", most=3)
    events = list(agent.stream("q"))
    assert events[-1]["status"] == "limit" and events[-1]["answer"] == "so far" and events[-2] == {"event": "summarizing", "steps": 3} and seen == [4]


def test_without_a_service_the_fixed_way_answers():
    agent = Agent({}, lambda messages: None, lambda messages: None, lambda q: f"fixed {q}")
    assert agent.run("x") == {"event": "result", "status": "fallback", "answer": "fixed x", "trace": []}
    assert Agent({}, lambda messages: None, lambda messages: None).run("x")["event"] == "error"


def test_a_decision_sees_the_end_of_the_history():
    sizes = []
    agent = Agent({}, lambda messages: sizes.append(len(messages)) or {"answer": "a"}, lambda m: "")
    for _ in range(15):
        agent.run("q", "s")
    assert sizes[:3] == [1, 3, 5] and sizes[-1] == HISTORY + 1 and len(agent.sessions["s"]) == 30


@pytest.mark.parametrize(("faults", "want", "pauses"), [([429, 503], "ok", [2.0, 4.0]), ([500, 502, 504], None, [2.0, 4.0]), ([404], None, []), ([], "ok", [])])
def test_passing_faults_are_tried_again(faults, want, pauses):
    left, slept = list(faults), []

    def call():
        if left:
            raise ServiceFault(left.pop(0))
        return "ok"

    assert patient(call, sleep=slept.append)() == want and slept == pauses


def test_any_other_fault_gives_nothing():
    assert patient(lambda: 1 / 0)() is None
