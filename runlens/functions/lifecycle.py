"""The lifecycle's states and transitions."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Which actions end a loop or leave it alone, and the parts of a state.
LOOP_CLEARED_BY = ("Crash", "Kill", "ReleaseSlot", "VerifyGreen", "StandDown", "EPOCH", "Retire")
LOOP_UNCHANGED_BY = ("Pause", "Resume")
LOOPS = ("none", "idle", "agent", "verify")
INTENTS = ("run", "paused", "killed")


@dataclass(frozen=True)
class State:
    """One cell's part of the model; ``attempts`` is counted apart."""
    loop: str = "none"
    intent: str = "run"
    slot: bool = False
    verify: bool = False
    rig: bool = False
    done: bool = False


# For each action what it needs of a state, what it sets, and what
# it adds to attempts by the loop it happens in. An action needs nothing of what
# is not named; attempts left before their verdict are taken back.
FREE = {"slot": False, "verify": False, "rig": False}
LIVE = ("idle", "agent", "verify")
RULES: dict[str, tuple[dict, dict, dict]] = {
    "Admit": ({"loop": ("none",), "intent": ("run",), "done": (False,), "slot": (False,)}, {"loop": "agent", "slot": True}, {"none": 1}),
    "ReleaseSlot": ({"loop": LIVE}, {"loop": "none", **FREE}, {"agent": -1, "verify": -1}),
    "StandDown": ({"loop": ("idle", "agent"), "intent": ("paused", "killed")}, {"loop": "none", "slot": False}, {"agent": -1}),
    "AcquireVerify": ({"loop": ("agent",), "intent": ("run",), "verify": (False,)}, {"loop": "verify", "verify": True}, {}),
    "AcquireRig": ({"loop": ("verify",), "rig": (False,)}, {"rig": True}, {}),
    "ReleaseRig": ({"rig": (True,)}, {"rig": False}, {}),
    "VerifyGreen": ({"loop": ("verify",)}, {"loop": "none", "done": True, **FREE}, {}),
    "VerifyFail": ({"loop": ("verify",)}, {"loop": "agent", "verify": False}, {}),
    "Crash": ({"loop": LIVE}, {"loop": "none", **FREE}, {"agent": -1, "verify": -1}),
    "Pause": ({"intent": ("run",)}, {"intent": "paused"}, {}),
    "Resume": ({"intent": ("paused",)}, {"intent": "run"}, {}),
    "Kill": ({"intent": ("run", "paused")}, {"intent": "killed"}, {}),
}


ACTIONS = tuple(RULES)


def step(state: State, action: str) -> tuple[State, int] | None:
    """The state that an action leads to and the change of attempts; nothing where the action may not happen."""
    needs, sets, gains = RULES[action]
    if all(getattr(state, part) in allowed for part, allowed in needs.items()):
        return replace(state, **sets), gains.get(state.loop, 0)
    return None


def states() -> list[State]:
    """Every state, the initial one first."""
    flags = (False, True)
    return [State(lo, i, s, v, r, d) for lo in LOOPS for i in INTENTS
            for s in flags for v in flags for r in flags for d in flags]
