"""Errors of the command interface, with their texts."""

from __future__ import annotations


class EngineError(Exception):
    """A failed command; ``location`` says where."""

    def __init__(self, text: str, location: str):
        super().__init__(f"{text} (at {location})")


# The places that error texts name.
ADD_SPACE_NAME, ADD_KEY_NAME, DELETE_KEY_NAME = "command::addspace::addspace", "command::addkey::addkey", "command::deletekey::deletekey"
ADD_SPACE, GET_SPACE, ADD_KEY, GET_KEY = "io::storage::add_space", "io::storage::get_space", "io::space::add_key", "io::space::get_key"
FILTER, SET, PUT = "io::key::filter_value", "io::key::set_value", "io::key::put_value"
RANGE, SELECT, PACKET = "command::tools::select::select", "command::select::select", "packet"

# The rule for names, and the texts below.
NAME_RULE = "only a-z, A-Z, 0-9, - _ . @ + = allowed, max 256 characters"


def invalid_space(name: str, where: str) -> EngineError:
    return EngineError(f"Invalid space name '{name}': {NAME_RULE}", where)


def invalid_key(name: str, where: str) -> EngineError:
    return EngineError(f"Invalid key name '{name}': {NAME_RULE}", where)


def parse_error(message: str, where: str) -> EngineError:
    return EngineError(f"Parse error: {message}", where)


def space_exists(name: str, where: str) -> EngineError:
    return EngineError(f"Space '{name}' already exists", where)


def space_missing(name: str, where: str) -> EngineError:
    return EngineError(f"Space '{name}' not found", where)


def key_exists(key: str, space: str, where: str) -> EngineError:
    return EngineError(f"Key '{key}' already exists in space '{space}'", where)


def key_missing(key: str, space: str, where: str) -> EngineError:
    return EngineError(f"Key '{key}' not found in space '{space}'", where)


def value_exists(ids: str, where: str) -> EngineError:
    return EngineError(f"Value already exists for SpaceTimeId '{ids}'", where)


def filter_mismatch(kind: str, operation: str, where: str) -> EngineError:
    return EngineError(f"Type mismatch: expected '{kind}' type for {operation} operation", where)


def value_mismatch(expected: str, received: str, where: str) -> EngineError:
    return EngineError(f"Type mismatch: expected '{expected}' but received '{received}'", where)
