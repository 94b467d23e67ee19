"""Settings of mining and of training-data preparation, read from YAML by ``load_config``.

``None`` sections mean the defaults. Settings of model servers and trainers, which are outside this engine, are
accepted and kept as ``outside``. Unknown keys and sections that aren't mappings are errors.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

#: Fixed value: the prompt template.
PROMPT_TEMPLATE = '{prompt}\n\nThink through the problem step by step, then respond with your final answer as "Answer: <your answer>".'


#: Settings of parts outside this engine.
SERVING = frozenset(
    "api_base_url api_key model_name tokenizer_name output_jsonl generations_jsonl hf_split target_pair_batch_size threads generation_backend request_batch_size save_token_trace token_trace_statuses "
    "vllm_dtype vllm_tensor_parallel_size vllm_max_model_len vllm_gpu_memory_utilization vllm_enable_prefix_caching vllm_trust_remote_code vllm_kwargs system_prompt max_prompt_tokens max_new_tokens "
    "temperatures top_p top_k min_p top_logprobs timeout stop skip_decoded_shorter_than".split()
)
TRAINER = frozenset("output_dir merge_lora warmup_ratio weight_decay lora_r lora_alpha lora_dropout lora_ensure_weight_tying freeze_early_layers n_layers_unfrozen target_modules load_in_4bit bf16 optim".split())
#: Other names of settings.
ALIASES = {"hf_dataset": "dataset_path", "hf_source_field": "source_field", "hf_source_values": "source_values"}


@dataclass(frozen=True)
class Repetition:
    """Thresholds of the detector."""

    min_repeats: int = 4
    max_period: int = 1024
    min_period: int = 1
    min_total_repeated: int = 60
    sample_len: int = 16
    sample_interval: int = 128


@dataclass(frozen=True)
class Choice:
    """Which alternatives become chosen tokens."""

    max_tokens: int = 20
    top_k: int | None = 50
    min_p: float | None = None
    min_decoded_chars: int = 1
    require_alnum: bool = False
    skip_raw_token_substrings: tuple[str, ...] = ()


@dataclass
class MiningConfig:
    input_jsonl: Path | None = None
    dataset_path: Path | None = None
    source_field: str | None = "source"
    source_values: list[str] = field(default_factory=list)
    prompt_field: str = "conversations"
    max_prompts: int | None = None
    skip_eval_key_substrings: list[str] = field(default_factory=lambda: ["bfcl", "tau", "browse", "search"])
    prompt_template: str = PROMPT_TEMPLATE
    target_pairs: int | None = 10_000
    temperature: float = 0.1
    repetition: dict[str, Any] = field(default_factory=dict)
    chosen: dict[str, Any] = field(default_factory=dict)
    outside: dict[str, Any] = field(default_factory=dict)

    def thresholds(self) -> Repetition:
        return Repetition(**(self.repetition or {}))

    def choice(self) -> Choice:
        return Choice(**{k: tuple(v) if isinstance(v, list) else v for k, v in self.chosen.items()})


@dataclass
class TrainingConfig:
    dataset_jsonl: Path | None = None
    model_name: str = ""
    merged_output_dir: Path = Path("runs/merged")
    auto_merged_output_name: bool = True
    max_seq_length: int = 4096
    batch_size: int = 1
    gradient_accumulation_steps: int = 16
    num_epochs: float = 1.0
    learning_rate: float = 1e-6
    seed: int = 3407
    max_train_examples: int | None = None
    rejected_regularisation_strength: float = 0.8
    chosen_regularisation_strength: float = 0.0
    source_balance_mode: str = "off"
    min_chosen_tokens: int = 1
    filter_rejected_stop_words: bool = True
    lambda_mse_target: float = 0.05
    tau_mse_target: float = 0.5
    lambda_mse: float = 0.4
    clip_epsilon_logits: float = 2.0
    early_stopping_chosen_win: float | None = 0.85
    outside: dict[str, Any] = field(default_factory=dict)


@dataclass
class EngineConfig:
    model_name: str | None = None
    generation: MiningConfig = field(default_factory=MiningConfig)
    train: TrainingConfig = field(default_factory=TrainingConfig)


def _section(kind: type, given: Any, name: str):
    if given is None:
        return kind()
    if not isinstance(given, dict):
        raise ValueError(f"section {name!r} must be a mapping")
    fields = {f.name: str(f.type) for f in dataclasses.fields(kind)}
    elsewhere = SERVING if kind is MiningConfig else TRAINER
    taken: dict[str, Any] = {"outside": {k: v for k, v in given.items() if k in elsewhere and k not in fields}}
    for key, value in given.items():
        key = ALIASES.get(key, key)
        if kind is MiningConfig and key.startswith("chosen_"):
            taken.setdefault("chosen", {})[key.removeprefix("chosen_")] = value
        elif key not in taken["outside"]:
            taken[key] = Path(value) if "Path" in fields.get(key, "") and isinstance(value, str) and value else value
    return kind(**taken)


def parse_config(given: Any) -> EngineConfig:
    if given is None:
        return EngineConfig()
    if not isinstance(given, dict):
        raise ValueError("the configuration must be a mapping")
    known = {"model_name", "generation", "train"}
    if extra := sorted(set(given) - known):
        raise ValueError(f"unknown top-level keys: {', '.join(extra)}")
    name = given.get("model_name")
    return EngineConfig(None if name is None else str(name), _section(MiningConfig, given.get("generation"), "generation"), _section(TrainingConfig, given.get("train"), "train"))


def load_config(path: str | Path) -> EngineConfig:
    import yaml

    return parse_config(yaml.safe_load(Path(path).read_text(encoding="utf-8")))
