"""Expressions over repository paths: what is scanned, what is denied, which parser reads a file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which names and suffixes a scan passes over, and which a parser takes.
DENIED_DIRECTORIES = (
    ".git .gradle .idea .mypy_cache .next .nuxt .pytest_cache .ruff_cache .venv .vscode __pycache__ build coverage dist "
    "node_modules out target vendor venv"
).split()
DENIED_NAMES = (
    ".ds_store bun.lock bun.lockb cargo.lock composer.lock gemfile.lock go.sum package-lock.json pipfile.lock "
    "pnpm-lock.yaml poetry.lock uv.lock yarn.lock"
).split()
SECRET_NAMES = (
    ".env .envrc .netrc .npmrc .pypirc _netrc credentials.json id_dsa id_ecdsa id_ed25519 id_rsa service-account.json "
    "service_account.json"
).split()
SAFE_TEMPLATES = ".env.example .env.sample .env.template".split()
DENIED_ENDINGS = ".min.js .min.css .map .log".split()
DENIED_SUFFIXES = (
    ".7z .a .bin .bmp .bz2 .class .db .dll .doc .docx .dylib .exe .flac .gif .gz .ico .jar .jpeg .jpg .key .m4a .mkv "
    ".mov .mp3 .mp4 .o .obj .ogg .otf .p12 .pfx .pdf .pem .png .ppt .pptx .pyc .pyo .rar .so .sqlite .sqlite3 .svg "
    ".tar .tgz .tif .tiff .ttf .war .wasm .wav .webm .webp .whl .woff .woff2 .xls .xlsx .xz .zip"
).split()
DOCUMENTATION_SUFFIXES = ".markdown .md .rst .txt".split()
DOCUMENTATION_NAMES = "changelog license notice readme".split()
CONFIGURATION_SUFFIXES = ".cfg .ini .json .toml .yaml .yml".split()
CONFIGURATION_NAMES = ".editorconfig .env.example .env.sample .env.template .gitignore dockerfile".split()
MAX_FILE_BYTES, SNIFF_BYTES = 1_048_576, 8_192


def name(path: Column) -> Column:
    """Last part of a path."""
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Lower-case suffix with its dot; empty for a name without one, or with only a leading one."""
    return F.lower(F.regexp_extract(name(path), r"[^.].*?(\.[^.]+)$", 1))


def denied_directory(path: Column) -> Column:
    """Whether some directory above the file is never scanned."""
    parts = F.transform(F.split(path, "/"), F.lower)
    above = F.slice(parts, 1, F.size(parts) - 1)
    return F.arrays_overlap(above, F.array(*map(F.lit, DENIED_DIRECTORIES)))


def denied_file(path: Column) -> Column:
    """Whether a file is never read because of its name: secrets, lock files, minified and binary files."""
    n = F.lower(name(path))
    endings = reduce(lambda a, b: a | b, [F.endswith(n, F.lit(e)) for e in DENIED_ENDINGS])
    return (
        F.when(n.isin(SAFE_TEMPLATES), False)
        .when(n.isin(SECRET_NAMES) | F.startswith(n, F.lit(".env.")), True)
        .when(n.isin(DENIED_NAMES) | endings, True)
        .otherwise(suffix(path).isin(DENIED_SUFFIXES))
    )


def binary(content: Column) -> Column:
    """Whether bytes look binary: a NUL near the beginning."""
    return F.contains(F.substring(content, 1, SNIFF_BYTES), F.lit(b"\x00"))


def parser(path: Column) -> Column:
    """The parser that reads a file; null if only its metadata is kept."""
    s, n = suffix(path), F.lower(name(path))
    documentation = s.isin(DOCUMENTATION_SUFFIXES) | ((s == "") & n.isin(DOCUMENTATION_NAMES))
    return (
        F.when(s == ".py", "python")
        .when(s.isin(".js", ".jsx"), "javascript")
        .when(s == ".ts", "typescript")
        .when(documentation, "documentation")
        .when(s.isin(CONFIGURATION_SUFFIXES) | n.isin(CONFIGURATION_NAMES), "configuration")
    )


def valid_relative(path: Column) -> Column:
    """Whether a path is relative, in POSIX form, without dot or empty parts and without control characters."""
    bad = F.exists(F.split(path, "/"), lambda p: p.isin("", ".", ".."))
    return path.isNotNull() & ~bad & ~path.rlike(r"[\x00-\x1F\x7F\\]")


def in_nested_repository(path: Column, roots: Column) -> Column:
    """Whether a file lies below one of the nested repository roots (an array of directories)."""
    return F.exists(roots, lambda r: F.startswith(path, F.concat(r, F.lit("/"))))
