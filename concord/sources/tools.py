"""External programs: where they are, and the command lines that a bulk move with them would take.

Nothing here runs a program; commands are lists of words whose secrets are references to the environment, so
that they can be shown, reviewed and run by whoever may.
"""

from __future__ import annotations

import os
import shutil
from urllib.parse import quote

from concord.model import Endpoint, Pair

#: Programs that commands can make use of, by engine.
PROGRAMS = {
    "postgres": ("psql", "pg_dump", "pg_restore"),
    "mysql": ("mysql", "mydumper", "myloader"),
    "hetero": ("pgloader",),
    "mongodb": ("mongodump", "mongorestore"),
    "mssql": ("sqlcmd",),
    "kafka": ("kafka-configs",),
}


def search_path(extra: str = "") -> str:
    """The folders that are searched: those of CONCORD_TOOLS first, then ``extra`` and the usual ones."""
    return os.pathsep.join(x for x in (os.environ.get("CONCORD_TOOLS", ""), extra, os.environ.get("PATH", "")) if x)


def which(program: str, extra: str = "") -> str | None:
    return shutil.which(program, path=search_path(extra))


def inventory(engine: str = "") -> dict[str, str | None]:
    """Each program and where it is, or None."""
    return {p: which(p) for name, programs in PROGRAMS.items() if engine in ("", name) for p in programs}


def document_uri(end: Endpoint, database: str, secret: str) -> str:
    """The address of a document store, with the password as a reference."""
    user = f"{quote(end.user, safe='')}:${{{secret}}}@" if end.user else ""
    source = f"?authSource={end.options['auth_source']}" if end.options.get("auth_source") else ""
    return f"mongodb://{user}{end.host}:{end.port}/{database}{source}"


def _server(end: Endpoint, host: str, port: str, user: str) -> list[str]:
    return [host, end.host, port, str(end.port), user, end.user]


def move_commands(pair: Pair, database: str, via: str, folder: str = "dump") -> list[list[str]]:
    """The steps of a whole-database move by an external program, in order."""
    src, dst, target, jobs = pair.source, pair.target, pair.target_db(database), str(pair.workers)
    if via == "pgdump":
        ends = [_server(e, "--host", "--port", "--username") for e in (src, dst)]
        return [
            ["pg_dump", *ends[0], "--format=directory", f"--jobs={jobs}", "--data-only", f"--file={folder}", database],
            ["pg_restore", *ends[1], f"--jobs={jobs}", "--data-only", "--disable-triggers", f"--dbname={target}", folder],
        ]
    if via == "mydumper":
        ends = [_server(e, "--host", "--port", "--user") for e in (src, dst)]
        return [
            ["mydumper", *ends[0], "--database", database, "--threads", jobs, "--trx-consistency-only", "--outputdir", folder],
            ["myloader", *ends[1], "--database", target, "--threads", jobs, "--overwrite-tables", "--directory", folder],
        ]
    if via == "pgloader":
        return [["pgloader", "--with", "data only", f"mysql://{src.user}:${{SOURCE_PASSWORD}}@{src.host}:{src.port}/{database}", f"postgresql://{dst.user}:${{TARGET_PASSWORD}}@{dst.host}:{dst.port}/{target}"]]
    if via == "mongodump":
        return [["mongodump", f"--uri={document_uri(src, database, 'SOURCE_PASSWORD')}", f"--archive={folder}"], ["mongorestore", f"--uri={document_uri(dst, target, 'TARGET_PASSWORD')}", f"--nsFrom={database}.*", f"--nsTo={target}.*", "--drop", f"--archive={folder}"]]
    raise ValueError(f"no commands for {via!r}; the builtin copy needs none")


def replication_statements(pair: Pair, database: str) -> list[tuple[str, str]]:
    """(side, statement) that set up the engine's own replication; text only, the secret is a reference."""
    src, target, name = pair.source, pair.target_db(database), f"concord_{database}"
    if pair.engine == "postgres":
        return [
            ("source", f"CREATE PUBLICATION {name} FOR ALL TABLES;"),
            ("target", f"CREATE SUBSCRIPTION {name} CONNECTION 'host={src.host} port={src.port} dbname={database} user={src.user} password=${{SOURCE_PASSWORD}}' PUBLICATION {name} WITH (copy_data = false);"),
        ]
    if pair.engine == "mysql":
        return [
            ("target", f"CHANGE REPLICATION SOURCE TO SOURCE_HOST='{src.host}', SOURCE_PORT={src.port}, SOURCE_USER='{src.user}', SOURCE_PASSWORD='${{SOURCE_PASSWORD}}', SOURCE_AUTO_POSITION=1;"),
            *([("target", f"CHANGE REPLICATION FILTER REPLICATE_REWRITE_DB=(({database}, {target}));")] if target != database else []),
            ("target", "START REPLICA;"),
        ]
    raise ValueError(f"{pair.engine} has no replication of its own here; follow its changes instead")
