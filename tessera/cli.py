"""A small prompt over the in-process commands: ``python -m tessera.cli FOLDER``."""

from __future__ import annotations

import json
import sys

from .sources.command import Commands


def request(line: str, db: str) -> dict | None:
    """The command of one line, or None for an empty or unknown one."""
    word, _, rest = line.strip().partition(" ")
    name, _, body = rest.strip().partition(" ")
    plain = dict(ping="ping", status="server_status", dbs="list_databases", databases="list_databases")
    here = dict(find="find", count="count", delete="delete_many")
    if word in plain:
        return dict(type=plain[word])
    if word == "createdb":
        return dict(type="create_database", name=name)
    in_db = dict(database=db)
    if word == "collections":
        return dict(in_db, type="list_collections")
    if word in ("createcol", "createcollection"):
        return dict(in_db, type="create_collection", name=name)
    if word == "insert":
        return dict(in_db, type="insert_one", collection=name, document=json.loads(body))
    return dict(in_db, type=here[word], collection=name, filter=json.loads(body or "{}")) if word in here else None


def main(folder: str) -> None:
    from pyspark.sql import SparkSession

    commands, db = Commands(SparkSession.builder.getOrCreate(), folder), "default"
    for line in iter(lambda: input(f"{db}> "), "exit"):
        if line.startswith("use "):
            db = line[4:].strip()
            continue
        try:
            command = request(line, db)
        except json.JSONDecodeError as e:
            print(f"not JSON: {e}")
            continue
        print(json.dumps(commands.execute(command), indent=2) if command else "unknown command")


if __name__ == "__main__":
    main(sys.argv[1])
