"""Project files: package manifests, TypeScript paths, workspaces, Python requirements, entry points.

Configuration is small and read on the driver; what comes out are the alias
rows, package names and entry labels that the operators take as tables.
"""

from __future__ import annotations

import json
import posixpath
import re
from dataclasses import dataclass, field
from pathlib import Path

# Conditions of an export in order, dependency sections.
CONDITIONS = ("source", "import", "module", "default", "require", "node")
SECTIONS = ("dependencies", "devDependencies", "peerDependencies")
# Packages that name a framework, in the order in which frameworks are shown.
FRAMEWORKS = {
    "next": "Next.js", "nuxt": "Nuxt", "@angular/core": "Angular", "@nestjs/core": "NestJS", "react": "React", "vue": "Vue", "svelte": "Svelte", "solid-js": "Solid",
    "express": "Express", "fastify": "Fastify", "koa": "Koa", "hono": "Hono", "@trpc/server": "tRPC", "graphql": "GraphQL", "@prisma/client": "Prisma", "drizzle-orm": "Drizzle",
    "typeorm": "TypeORM", "mongoose": "Mongoose", "kysely": "Kysely", "next-auth": "Auth.js", "@auth/core": "Auth.js", "passport": "Passport", "stripe": "Stripe",
    "@supabase/supabase-js": "Supabase", "firebase": "Firebase", "redis": "Redis", "ioredis": "Redis", "bullmq": "BullMQ", "socket.io": "Socket.IO", "electron": "Electron",
    "react-native": "React Native", "tailwindcss": "Tailwind CSS", "vite": "Vite", "webpack": "webpack", "vitest": "Vitest", "jest": "Jest", "@playwright/test": "Playwright", "zod": "Zod",
    "django": "Django", "flask": "Flask", "sqlalchemy": "SQLAlchemy", "djangorestframework": "DRF",
}


@dataclass
class Profile:
    """What the project files of a repository say."""

    name: str | None = None
    description: str | None = None
    deps: set[str] = field(default_factory=set)
    package_dirs: list[str] = field(default_factory=list)
    scopes: list[tuple[str, list[tuple[str, list[str]]], str | None]] = field(default_factory=list)
    packages: list[dict] = field(default_factory=list)
    entries: list[str] = field(default_factory=list)
    root_imports: list[tuple[str, list[str]]] = field(default_factory=list)
    scope_deps: dict[str, set[str]] = field(default_factory=dict)
    manage: bool = False

    def frameworks(self, scope: str = "") -> list[str]:
        deps = self.scope_deps.get(scope, set()) if scope else self.deps
        found = {FRAMEWORKS[d] for d in deps if d in FRAMEWORKS} | ({"Django"} if self.manage and not scope else set())
        return [f for f in dict.fromkeys(FRAMEWORKS.values()) if f in found]

    def scope_of(self, rel: str) -> str:
        return max((d for d in self.package_dirs if rel.startswith(d + "/")), key=len, default="")


def strip_jsonc(text: str) -> str:
    """JSON without comments and trailing commas; strings are left alone."""
    string = r'"(?:[^"\\]|\\.)*"'
    text = re.sub(rf"({string})|//[^\n]*|/\*[\s\S]*?\*/", lambda m: m.group(1) or "", text)
    return re.sub(rf"({string})|,(?=\s*[}}\]])", lambda m: m.group(1) or "", text)


def read_json(path: Path) -> dict | None:
    try:
        v = json.loads(strip_jsonc(path.read_text(encoding="utf-8-sig", errors="replace")))
    except (OSError, ValueError):
        return None
    return v if isinstance(v, dict) else None


def rebase(base: str, target: str) -> str:
    """A path of a manifest in ``base`` as a path of the repository."""
    p = posixpath.normpath(posixpath.join(base, target.replace("\\", "/").lstrip("/") if target.startswith("/") else target.replace("\\", "/")))
    while p.startswith("../"):
        p = p[3:]
    return "" if p in (".", "..") else p


def _target(value: object) -> str | None:
    if isinstance(value, str):
        return value
    if isinstance(value, dict):
        return next((value[k] for k in CONDITIONS if isinstance(value.get(k), str)), None)
    return None


def _strings(v: object) -> list[str]:
    return [v] if isinstance(v, str) else [x for x in v if isinstance(x, str)] if isinstance(v, list) else []


def pattern_covers(pattern: str, rel: str) -> bool:
    """Whether a workspace pattern (``*`` within a segment, ``**`` over segments) names the directory or one above it."""
    pat = [p for p in pattern.strip("./").split("/") if p]
    segs = rel.split("/")

    def match(i: int, j: int) -> bool:
        if i == len(pat):
            return True
        if pat[i] == "**":
            return any(match(i + 1, k) for k in range(j, len(segs) + 1))
        return j < len(segs) and re.fullmatch(re.escape(pat[i]).replace(r"\*", "[^/]*"), segs[j]) is not None and match(i + 1, j + 1)

    return match(0, 0)


def workspace_patterns(root: Path) -> list[str]:
    """Patterns of package.json and pnpm-workspace.yaml; negated ones are left out."""
    out: list[str] = []
    ws = (read_json(root / "package.json") or {}).get("workspaces")
    out += _strings(ws.get("packages") if isinstance(ws, dict) else ws)
    pnpm = root / "pnpm-workspace.yaml"
    if pnpm.is_file():
        inside = False
        for line in pnpm.read_text(errors="replace").splitlines():
            if re.match(r"packages\s*:", line):
                inside = True
            elif inside and (m := re.match(r"\s*-\s*['\"]?([^'\"#]+?)['\"]?\s*(?:#.*)?$", line)):
                out.append(m.group(1))
            elif line.strip() and not line[0].isspace():
                inside = False
    return [p for p in dict.fromkeys(out) if not p.startswith("!")]


def workspace_dirs(root: Path, patterns: list[str]) -> list[str]:
    """Directories that a pattern names and that hold a manifest, sorted."""
    out: set[str] = set()

    def expand(base: str, segs: list[str]) -> None:
        here = root / base
        if not segs:
            if base and any((here / m).is_file() for m in ("package.json", "pyproject.toml", "tsconfig.json")):
                out.add(base)
            return
        subs = [e.name for e in sorted(here.iterdir()) if e.is_dir() and not e.name.startswith(".") and e.name != "node_modules"] if here.is_dir() else []
        if segs[0] == "**":
            expand(base, segs[1:])
            for s in subs:
                expand(posixpath.join(base, s), segs)
        else:
            rule = re.compile(re.escape(segs[0]).replace(r"\*", "[^/]*") + r"\Z")
            for s in subs:
                if rule.match(s):
                    expand(posixpath.join(base, s), segs[1:])

    for p in patterns:
        expand("", [s for s in p.strip("./").split("/") if s])
    return sorted(out)


def load_tsconfig(root: Path, file: Path, names: dict[str, str], depth: int = 0) -> tuple[tuple[str, str] | None, tuple[dict, str] | None]:
    """(baseUrl, paths) each with the directory that declares it; parents first, the file's own last."""
    v = read_json(file) if depth <= 16 else None
    base, paths = None, None
    if v is None:
        return base, paths
    here = posixpath.relpath(file.parent.as_posix(), root.as_posix())
    here = "" if here == "." else here
    for spec in _strings(v.get("extends")):
        parent = _extends(root, file.parent, spec, names)
        if parent is not None:
            b, p = load_tsconfig(root, parent, names, depth + 1)
            base, paths = b or base, p or paths
    options = v.get("compilerOptions") if isinstance(v.get("compilerOptions"), dict) else {}
    if isinstance(options.get("baseUrl"), str):
        base = (options["baseUrl"], here)
    if isinstance(options.get("paths"), dict):
        paths = (options["paths"], here)
    return base, paths


def _extends(root: Path, at: Path, spec: str, names: dict[str, str]) -> Path | None:
    """The file a configuration extends: relative, of a workspace package, or installed."""
    if spec.startswith((".", "/")):
        bases = [at / spec]
    else:
        own = next((root / d / spec[len(n) :].lstrip("/") for n, d in names.items() if spec == n or spec.startswith(n + "/")), None)
        bases = [*([own] if own else []), root / "node_modules" / spec, at / "node_modules" / spec]
    for b in bases:
        for c in (b, b.with_name(b.name + ".json"), b / "tsconfig.json"):
            if c.is_file():
                return c
    return None


def extended_configs(root: Path, names: dict[str, str] | None = None) -> list[str]:
    """Paths of the repository's own files that its TypeScript configurations extend, however indirectly."""
    seen: set[Path] = set()

    def follow(file: Path, depth: int) -> None:
        v = read_json(file) if depth <= 16 else None
        for spec in _strings((v or {}).get("extends")):
            t = _extends(root, file.parent, spec, names or {})
            if t is not None and t.resolve().is_relative_to(root) and "node_modules" not in t.parts and t.resolve() not in seen:
                seen.add(t.resolve())
                follow(t.resolve(), depth + 1)

    for d in ["", *workspace_dirs(root, workspace_patterns(root))]:
        for n in ("tsconfig.json", "jsconfig.json"):
            if (root / d / n).is_file():
                follow(root / d / n, 0)
    return sorted(p.relative_to(root).as_posix() for p in seen)


def python_deps(dir_: Path) -> set[str]:
    """Normalised dependency names of pyproject.toml and requirements files of one directory."""
    out: set[str] = set()
    name = lambda s: re.sub(r"[-_.]+", "-", m.group(0)).lower() if (m := re.match(r"[A-Za-z0-9][\w.-]*", s.strip())) else ""
    py = dir_ / "pyproject.toml"
    if py.is_file():
        import tomllib

        try:
            t = tomllib.loads(py.read_text(errors="replace"))
        except tomllib.TOMLDecodeError:
            t = {}
        project = t.get("project", {}) if isinstance(t.get("project"), dict) else {}
        out |= {name(d) for d in _strings(project.get("dependencies", []))}
        for extra in (project.get("optional-dependencies") or {}).values():
            out |= {name(d) for d in _strings(extra)}
        poetry = t.get("tool", {}).get("poetry", {}) if isinstance(t.get("tool"), dict) else {}
        out |= {name(d) for d in poetry.get("dependencies", {}) if d.lower() != "python"}
    for req in sorted(dir_.glob("requirements*.txt")):
        out |= {name(x) for x in req.read_text(errors="replace").splitlines() if x.strip() and x.strip()[0] not in "#-"}
    return out - {""}


def _manifest_map(raw: dict, key: str, at: str) -> list[tuple[str, list[str]]]:
    m = raw.get(key)
    if not isinstance(m, dict):
        return []
    return [(k, [rebase(at, t)] if (t := _target(v)) else []) for k, v in m.items() if not (key == "exports" and k == ".") and not (key == "imports" and not k.startswith("#"))]


def read(root: str | Path) -> Profile:
    """The profile of a repository: root first, workspace packages in order, then nested applications' TypeScript paths."""
    root = Path(root).resolve()
    p = Profile(manage=(root / "manage.py").is_file() and "django" in (root / "manage.py").read_text(errors="replace"))
    p.package_dirs = workspace_dirs(root, workspace_patterns(root))
    raws = {d: read_json(root / d / "package.json") for d in ["", *p.package_dirs]}
    names = {r["name"]: d for d, r in raws.items() if d and r and isinstance(r.get("name"), str)}
    for d, raw in raws.items():
        deps = python_deps(root / d)
        if raw:
            p.name = p.name or (raw.get("name") if isinstance(raw.get("name"), str) else None)
            p.description = p.description or (raw.get("description") if isinstance(raw.get("description"), str) else None)
            deps |= {k for s in SECTIONS if isinstance(raw.get(s), dict) for k in raw[s]}
            tools = raw.get("bin")
            p.entries += [rebase(d, x) for x in _strings(raw.get("main")) + (_strings(tools) or _strings(list(tools.values()) if isinstance(tools, dict) else []))]
            if d and isinstance(raw.get("name"), str):
                exp = raw.get("exports")
                dot = _target(exp.get(".") if isinstance(exp, dict) else exp)
                entries = list(dict.fromkeys(rebase(d, x) for x in [dot, raw.get("module"), raw.get("main")] if isinstance(x, str)))
                p.packages.append({"name": raw["name"], "dir": d, "entries": entries, "exports": _manifest_map(raw, "exports", d), "imports": _manifest_map(raw, "imports", d)})
            elif not d:
                p.root_imports = _manifest_map(raw, "imports", "")
        # what the root declares already is not a package's own
        p.scope_deps[d] = deps - (p.deps if d else set())
        p.deps |= deps
    nested = [e.name for e in sorted(root.iterdir()) if e.is_dir() and not e.name.startswith(".") and e.name not in p.package_dirs and (e / "tsconfig.json").is_file() and e.name != "node_modules"]
    for d in ["", *p.package_dirs, *nested]:
        file = next((root / d / n for n in ("tsconfig.json", "jsconfig.json") if (root / d / n).is_file()), None)
        if file is None:
            continue
        base, paths = load_tsconfig(root, file, names)
        if base is None and paths is None:
            continue
        url = rebase(base[1], base[0]) if base else None
        anchor = url if url is not None else paths[1] if paths else ""
        rules = [(a, t) for a, v in (paths[0] if paths else {}).items() if (t := [rebase(anchor, x) for x in _strings(v)])]
        p.scopes.append((d, rules, url))
    return p


def alias_rows(p: Profile) -> list[tuple[str, str, str | None, int, bool]]:
    """``(scope, pattern, target, place, stop)``: for each scope its whole chain of lookups in order.

    Own paths; paths of other scopes whose pattern the own ones lack; own
    base; root base; other bases; then workspace packages by longest name.  A
    package's exports map that knows a subpath without a file ends the search.
    """
    first: dict[str, list[str]] = {}
    for _, rules, _ in p.scopes:
        for a, t in rules:
            first.setdefault(a, t)
    bases = [u for _, _, u in p.scopes if u is not None]
    root_base = next((u for d, _, u in p.scopes if not d), None)
    out = []
    for scope in ["", *sorted({d for d, _, _ in p.scopes if d} | {w["dir"] for w in p.packages})]:
        own = next(((r, u) for d, r, u in p.scopes if d == scope), ([], None)) if scope else ([], None)
        chain: list[tuple[str, str | None, bool]] = [(a, t, False) for a, ts in own[0] for t in ts]
        mine = {a for a, _ in own[0]}
        chain += [(a, t, False) for a, ts in first.items() if a not in mine for t in ts]
        for base in dict.fromkeys(b for b in (own[1], root_base, *bases) if b is not None):
            chain.append(("*", f"{base}/*" if base else "*", False))
        imports = next((w["imports"] for w in p.packages if w["dir"] == scope), [])
        for key, ts in [*imports, *p.root_imports]:
            chain += [(key, t, i == len(ts) - 1) for i, t in enumerate(ts)] or [(key, None, True)]
        for w in sorted(p.packages, key=lambda w: -len(w["name"])):
            chain += [(w["name"], t, False) for t in (*w["entries"], w["dir"], w["dir"] + "/src/index")]
            for key, ts in w["exports"]:
                sub = w["name"] + "/" + key.removeprefix("./")
                chain += [(sub, t, True) for t in ts] or [(sub, None, True)]
            chain += [(w["name"] + "/*", w["dir"] + "/*", False), (w["name"] + "/*", w["dir"] + "/src/*", False)]
        out += [(scope, a, t, i, s) for i, (a, t, s) in enumerate(chain)]
    return out


# File names that start a program, and Next.js file kinds.
GENERIC_ENTRIES = frozenset(f"{n}.{e}" for n in ("index", "main", "server", "app", "cli", "middleware") for e in ("ts", "js")) | {"__main__.py", "app.py", "main.py", "cli.py"}
APP_KINDS = {"page": "page", "route": "API"} | {k: k for k in ("layout", "loading", "error", "not-found", "opengraph-image", "twitter-image", "sitemap", "robots", "manifest", "favicon", "icon", "apple-icon")}


def _segment(s: str) -> str:
    return ":" + s[1:-1].lstrip(".") if s.startswith("[") and s.endswith("]") else s


def entry_labels(p: Profile, rels: list[str]) -> list[tuple[str, str]]:
    """``(rel, label)`` of entry points: framework files by the scope they lie in, generic names, manifest entries last."""
    out = []
    for rel in rels:
        scope = p.scope_of(rel)
        inner = rel[len(scope) + 1 :] if scope else rel
        used, trimmed = p.frameworks(scope), inner.removeprefix("src/")
        name = rel.rsplit("/", 1)[-1]
        if "Next.js" in used:
            kind = APP_KINDS.get(name.split(".", 1)[0])
            if trimmed.startswith("app/") and kind:
                segs = [_segment(s) for s in trimmed[4:].split("/")[:-1] if not (s.startswith("(") and s.endswith(")")) and not s.startswith("@")]
                out.append((rel, f"{kind} /{'/'.join(segs)}"))
                continue
            if trimmed.startswith("pages/") and not trimmed[6:].startswith("_"):
                bare = re.sub(r"(^|/)index$", "", trimmed[6:].rsplit(".", 1)[0])
                kind = "API" if trimmed[6:].startswith("api/") else "page"
                out.append((rel, f"{kind} /{'/'.join(_segment(s) for s in bare.split('/') if s)}"))
                continue
        if trimmed in GENERIC_ENTRIES or trimmed.endswith(("/__main__.py", "/app.py", "/main.py")):
            out.append((rel, f"entry: {rel}"))
        if "Django" in used:
            app = rel.rsplit("/", 2)[-2] if "/" in rel else "project"
            label = {"urls.py": f"urls {app}", "manage.py": "manage", "wsgi.py": "wsgi", "asgi.py": "asgi"}.get(name)
            if label:
                out.append((rel, label))
    known = set(rels)
    return out + [(e, f"manifest entry: {e}") for e in p.entries if e in known]
