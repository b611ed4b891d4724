"""Settings of a redaction run and the vocabulary all parts share."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

MODES = ("mask", "remove", "hash", "replace")

# Words of the agent protocols that are never personal information.
STRUCTURAL_TOKENS = frozenset(
    "agent_message ai apply_patch array assistant boolean cancelled commentary completed custom_tool_call custom_tool_call_output default developer disabled enabled error event_msg exec_command "
    "exec_command_output failed final_answer function function_call function_call_output high human in_progress input_text integer json local_shell_call low max medium message minimal model none null "
    "number object open_page output_text patch_apply_begin patch_apply_end read_thread_terminal reasoning response_item string success system text token_count tool tool_call tool_calls tool_result "
    "tool_use turn_context type update user web_search_call write_stdin xhigh".split()
)

# How a placeholder begins.
PLACEHOLDER_STARTS = ("<REDACTED:", "<HASHED:", "<REPLACED:")


class ModelRedactionError(RuntimeError):
    """The model failed; the whole run must stop."""


@dataclass(frozen=True)
class RedactionConfig:
    """Settings of one run; values are inlined into the plan as literals."""

    model_name: str = "local-ner"
    mode: str = "mask"
    regex_enabled: bool = True
    model_enabled: bool = True
    preserve_json_structure: bool = True
    include_report: bool = True
    chunk_size: int = 3000
    model_batch_size: int = 16
    confidence_threshold: float = 0.5
    seed: int = 2026

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"unknown redaction mode {self.mode!r}; known: {', '.join(MODES)}")

    def require_model(self, supported: Sequence[str] | None) -> None:
        """Refuse a model that the place of work does not have."""
        if self.model_enabled and supported is not None and self.model_name not in supported:
            raise ValueError(f"unsupported remote model {self.model_name!r}; supported: {', '.join(supported)}")

    def require_a_pass(self) -> None:
        if not (self.regex_enabled or self.model_enabled):
            raise ValueError("both the rules and the model are switched off; nothing would be redacted")
