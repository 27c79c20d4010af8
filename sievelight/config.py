"""Settings of a run: entropy, allow and block lists, custom patterns; read from TOML."""

from __future__ import annotations

import hashlib
import struct
import tomllib
import warnings
from dataclasses import dataclass, field
from pathlib import Path

from sievelight.functions.patterns import BUILT_IN, Pattern, check_custom

#: Part of every fingerprint, so that changed built-in rules void what older ones have cached.
RULESET = "1"
DEFAULT_MIN_BLOCK_BYTES = 8


class ConfigError(ValueError):
    """A setting that can't be used."""


@dataclass(frozen=True)
class Entropy:
    enabled: bool = True
    threshold: float = 4.5
    min_len: int = 20
    exclude: tuple[str, ...] = ()


@dataclass(frozen=True)
class Settings:
    """Everything that decides what is found; serialised into tasks as it is."""

    entropy: Entropy = Entropy()
    allow_hashes: frozenset[str] = frozenset()
    block_strings: tuple[str, ...] = ()
    block_hashes: frozenset[str] = frozenset()
    custom: tuple[Pattern, ...] = ()
    patterns: tuple[Pattern, ...] = field(default=BUILT_IN)
    source: bytes = b""
    #: Also apply the type router to lines that the cheap prefix test would skip.
    strict_router: bool = False

    @property
    def all_patterns(self) -> tuple[Pattern, ...]:
        return self.patterns + self.custom

    def fingerprint(self) -> str:
        """Hex digest of the configuration text, the entropy switch and threshold, and the rule set."""
        h = hashlib.sha256(self.source)
        h.update(b"entropy:on" if self.entropy.enabled else b"entropy:off")
        h.update(struct.pack("<d", self.entropy.threshold))
        h.update(RULESET.encode())
        return h.hexdigest()


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def block_list(strings: list[str] | tuple[str, ...], min_bytes: int = DEFAULT_MIN_BLOCK_BYTES) -> tuple[str, ...]:
    """Usable entries, different ones only, longest first."""
    kept = []
    for s in dict.fromkeys(strings):
        if len(s.encode()) < min_bytes:
            warnings.warn(f"block string of under {min_bytes} bytes ignored", stacklevel=2)
        elif s in "[REDACTED:":
            warnings.warn("block string that placeholders contain ignored", stacklevel=2)
        else:
            kept.append(s)
    return tuple(sorted(kept, key=lambda s: -len(s.encode())))


def parse(source: bytes, entropy: Entropy | None = None) -> Settings:
    """Settings from TOML text. Unknown keys are ignored, bad values raise ConfigError."""
    try:
        data = tomllib.loads(source.decode())
    except (tomllib.TOMLDecodeError, UnicodeDecodeError) as error:
        raise ConfigError(f"configuration can't be read: {error}") from error
    entropy = entropy or Entropy()
    block = data.get("blacklist", {})
    least = block.get("min_string_length")
    custom = tuple(
        check_custom(Pattern(p["name"], p["regex"], tuple(p.get("keywords", ())), p.get("secret_group"))) for p in data.get("patterns", ())
    )
    return Settings(
        entropy=Entropy(entropy.enabled, entropy.threshold, entropy.min_len, tuple(data.get("entropy", {}).get("exclude_patterns", ()))),
        allow_hashes=frozenset(h.lower() for h in data.get("allowlist", {}).get("hashes", ())),
        block_strings=block_list(block.get("strings", []), DEFAULT_MIN_BLOCK_BYTES if least is None else least),
        block_hashes=frozenset(h.lower() for h in block.get("hashes", ())),
        custom=custom,
        source=source,
    )


def load(path: str | Path | None, entropy: Entropy | None = None) -> Settings:
    """Settings of a file; defaults where there is none."""
    if path is None or not Path(path).exists():
        return Settings(entropy=entropy or Entropy())
    return parse(Path(path).read_bytes(), entropy)
