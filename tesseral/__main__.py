"""python -m tesseral packet.json [result.json] | --schema: runs a packet against a fresh store, or prints the JSON Schemas."""

from __future__ import annotations

import json
import sys

from tesseral.sources.packets import input_schema, output_schema, read_file, write_file


def main(arguments: list[str]) -> int:
    if arguments == ["--schema"]:
        print(json.dumps({"input": input_schema(), "output": output_schema()}, indent=2))
        return 0
    if not 1 <= len(arguments) <= 2:
        print(__doc__, file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from tesseral.engine import Engine

    engine = Engine(SparkSession.builder.appName("tesseral").getOrCreate())
    write_file(arguments[1] if len(arguments) > 1 else "result.json", engine.execute(read_file(arguments[0])))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
