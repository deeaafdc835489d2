"""Names and settings a user can override: source columns, vocabulary, experiment."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class SourceColumns:
    """Column names of a flat collaborative event log."""

    # Attribute keys of the event-log standard and its collaborative extension.
    case: str = "case:concept:name"
    activity: str = "concept:name"
    timestamp: str = "time:timestamp"
    elem_type: str = "collab:elemType"
    participant: str = "collab:participant"
    from_participant: str = "collab:fromParticipant"
    to_participant: str = "collab:toParticipant"

    @property
    def mandatory(self) -> tuple[str, ...]:
        return (self.case, self.activity, self.timestamp, self.elem_type, self.participant)

    @property
    def optional(self) -> tuple[str, ...]:
        return (self.from_participant, self.to_participant)

    @property
    def consumed(self) -> frozenset[str]:
        return frozenset(self.mandatory + self.optional)


@dataclass(frozen=True)
class Vocabulary:
    """Type, qualifier and attribute names of the object-centric model."""

    # Names written to and read from object-centric logs.
    # object types
    instance: str = "CollaborationInstance"
    participant: str = "Participant"
    local_case: str = "LocalCase"
    message: str = "Message"
    # event-to-object qualifiers
    within: str = "within"
    local: str = "local"
    send: str = "send"
    receive: str = "receive"
    actor: str = "actor"
    # object-to-object qualifiers
    part_of: str = "part_of"
    executed_by: str = "executed_by"
    from_: str = "from"
    to: str = "to"
    exchanged_in: str = "exchanged_in"
    # attributes
    case_id_attr: str = "caseId"
    name_attr: str = "name"
    participant_attr: str = "participant"
    sender_attr: str = "sender"
    receiver_attr: str = "receiver"
    elem_type_attr: str = "elemType"
    # element types
    task_elem: str = "task"
    send_elem: str = "SendTask"
    receive_elem: str = "ReceiveTask"


VOCABULARY = Vocabulary()


@dataclass(frozen=True)
class LogSpec:
    """One named log; `events` is an event-log file or folder, `relations` a relational folder."""

    name: str
    events: str | None = None
    relations: str | None = None


@dataclass(frozen=True)
class Experiment:
    """Evaluation settings."""

    # Published evaluation settings.
    folds: int = 5
    seed: int = 3395
    trees: int = 200
    tolerance_seconds: float = 1.0
    # The published runs had no depth limit; trees of pure leaves rarely get as deep.
    max_depth: int = 1000
    tasks: tuple[str, ...] = field(
        default=("NE-NPaA", "NE-NMPr", "NV-PrT", "NV-PaT", "NV-NMPr", "OB-M"))
    participant: str | None = None
    activity: str | None = None
