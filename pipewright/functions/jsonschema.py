"""JSON Schema (Draft 7 subset) compiled into Catalyst expressions.

A registered schema is a small document; the events it checks are many. So
the schema is turned, once per plan on the driver, into one Column over the
event's VARIANT value that yields ``ARRAY<STRING>`` of error messages (empty
= valid). Validation is then a projection inside whole-stage codegen: no
Python runs per row.

Supported keywords (anything else with assertion meaning is rejected at
registration, so a bad schema never reaches the hot path):

* tier A: type, required, properties, enum, const, minimum
* tier B: maximum, exclusiveMinimum, exclusiveMaximum, multipleOf,
  minLength, maxLength, pattern, items (schema or list), additionalItems,
  minItems, maxItems, uniqueItems, contains, additionalProperties,
  patternProperties, propertyNames, minProperties, maxProperties,
  dependencies, allOf, anyOf, oneOf, not, if/then/else, boolean schemas,
  local non-recursive ``$ref`` into ``definitions``.

Error messages follow one catalogue (``pointer: message``), parent first,
keywords in a fixed order: type, const, enum, numeric bounds, string
bounds, object keywords, array keywords, combinators.
"""

from __future__ import annotations

import json
import re
import uuid
from typing import Any

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Fixed message catalogue (ours; the documented shape is
# "/amount: must be >= 0 (got -99.99)").
ROOT_POINTER = "/"
# Placed in the error array when a numeric check meets a non-finite number;
# callers turn an array holding it into the single "not valid JSON" error.
NOT_JSON_MARK = "\u0000not-json"


def finalize(errors: Column, not_json_message: str = "payload is not valid JSON") -> Column:
    """Errors as reported: the not-JSON mark replaces the whole array."""
    return F.when(F.array_contains(errors, F.lit(NOT_JSON_MARK)),
                  F.array(F.lit(not_json_message))).otherwise(errors)

ANNOTATIONS = {"title", "description", "default", "examples", "$schema", "$id",
               "$comment", "readOnly", "writeOnly"}
_ASSERTIONS = {"type", "required", "properties", "enum", "const", "minimum",
               "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf",
               "minLength", "maxLength", "pattern", "items", "additionalItems",
               "minItems", "maxItems", "uniqueItems", "contains",
               "additionalProperties", "patternProperties", "propertyNames",
               "minProperties", "maxProperties", "dependencies", "allOf",
               "anyOf", "oneOf", "not", "if", "then", "else", "$ref", "definitions"}
_JSON_TYPES = ("object", "array", "string", "number", "integer", "boolean", "null")
_NUMERIC = r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"
_SIMPLE_KEY = re.compile(r"^[A-Za-z0-9_\- .:@$]*$")


class SchemaCompileError(ValueError):
    """The schema document cannot be compiled (rejected at registration)."""


# ---------------------------------------------------------------------------
# Small expression helpers over a VARIANT column
# ---------------------------------------------------------------------------

def _ty(v: Column) -> Column:
    """JSON type name of a variant: object, array, string, boolean, null or
    number (NULL for a missing value). Objects and arrays are recognised by a
    cast to an empty struct / an array of variants, so a container is not
    walked to print its full nested type."""
    scalar = F.schema_of_variant(v)
    return (F.when(v.isNull(), F.lit(None).cast("string"))
            .when(F.try_variant_get(v, "$", "struct<>").isNotNull(), F.lit("object"))
            .when(F.try_variant_get(v, "$", "array<variant>").isNotNull(), F.lit("array"))
            .when(scalar == "STRING", F.lit("string"))
            .when(scalar == "BOOLEAN", F.lit("boolean"))
            .when(scalar == "VOID", F.lit("null"))
            .otherwise(F.lit("number")))


class _Node:
    """Typed views of one variant value, built once per schema node."""

    def __init__(self, v: Column, ty: Column | None = None):
        self.v = v
        ty = _ty(v) if ty is None else ty
        self.ty = ty
        self.is_object = ty == F.lit("object")
        self.is_array = ty == F.lit("array")
        self.is_string = ty == F.lit("string")
        self.is_bool = ty == F.lit("boolean")
        self.is_null = ty == F.lit("null")
        self.is_number = ty == F.lit("number")
        self.num = F.try_variant_get(v, "$", "double")
        self.str = F.try_variant_get(v, "$", "string")
        # 1e400 parses to Infinity here; a strict JSON decoder rejects it
        self.is_inf = self.is_number & (F.abs(self.num) == F.lit(float("inf")))

    @property
    def is_integer(self) -> Column:
        return self.is_number & (self.num == F.floor(self.num))

    def type_name(self) -> Column:
        return self.ty

    def number_text(self) -> Column:
        """Canonical text of a number: plain decimal, no trailing zeros."""
        dec = F.try_variant_get(self.v, "$", "decimal(38,9)")
        plain = F.regexp_replace(dec.cast("string"), r"\.?0+$", "")
        return F.coalesce(plain, F.to_json(self.v))

    def json_text(self) -> Column:
        return F.when(self.is_number, self.number_text()).otherwise(F.to_json(self.v))


def _string_variant(s: Column) -> Column:
    """A VARIANT holding the string ``s``."""
    return F.variant_get(F.parse_json(F.to_json(F.struct(s.alias("k")))), "$.k", "variant")


def _child(v: Column, key: str) -> Column:
    if _SIMPLE_KEY.match(key) and '"' not in key:
        return F.variant_get(v, '$["%s"]' % key, "variant")
    as_map = F.try_variant_get(v, "$", "map<string,variant>")
    return F.try_element_at(as_map, F.lit(key))


def _ptr(base: str, token: str) -> str:
    token = token.replace("~", "~0").replace("/", "~1")
    return ("" if base == ROOT_POINTER else base) + "/" + token


def _fmt_num(x: Any) -> str:
    if isinstance(x, bool):
        raise SchemaCompileError("expected a number, got a boolean")
    if isinstance(x, int):
        return str(x)
    if float(x).is_integer():
        return str(int(x))
    return repr(float(x))


def _canon(x: Any) -> str:
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _lit_display(x: Any) -> str:
    if isinstance(x, str):
        return x
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return _fmt_num(x)
    return _canon(x)


def _msg(ptr: str, text: str | Column) -> Column:
    if isinstance(text, str):
        return F.lit(f"{ptr}: {text}")
    return F.concat(F.lit(f"{ptr}: "), text)


_EMPTY = "array<string>"


def _empty() -> Column:
    return F.array().cast(_EMPTY)


def _one(cond: Column, ptr: str, text: str | Column) -> tuple[str, Column]:
    """A simple keyword's error: the message when cond holds, else NULL."""
    return ("s", F.when(cond, _msg(ptr, text)))


def _arr(col: Column) -> tuple[str, Column]:
    return ("a", col)


def _gate(parts: list, cond: Column) -> list:
    """Apply ``cond`` to every part (messages become NULL, arrays empty)."""
    out = []
    for kind, c in parts:
        out.append((kind, F.when(cond, c)) if kind == "s"
                   else (kind, F.when(cond, c).otherwise(_empty())))
    return out


def _combine(parts: list) -> Column:
    """Parts in order -> one ARRAY<STRING>. Runs of simple messages become
    one ``array_compact(array(...))`` (small generated code); child arrays
    are concatenated between them."""
    groups: list[Column] = []
    buf: list[Column] = []
    for kind, c in parts:
        if kind == "s":
            buf.append(c)
            continue
        if buf:
            groups.append(F.array_compact(F.array(*buf)))
            buf = []
        groups.append(c)
    if buf:
        groups.append(F.array_compact(F.array(*buf)))
    if not groups:
        return _empty()
    return groups[0] if len(groups) == 1 else F.concat(*groups)


def _equals_literal(node: _Node, value: Any) -> Column:
    """Type-and-value equality between a variant and a JSON literal."""
    if value is None:
        return node.is_null
    if isinstance(value, bool):
        return node.is_bool & (F.try_variant_get(node.v, "$", "boolean") == F.lit(value))
    if isinstance(value, (int, float)):
        return node.is_number & (node.num == F.lit(float(value)))
    if isinstance(value, str):
        return node.is_string & (node.str == F.lit(value))
    # containers: canonical JSON text (variant objects keep keys sorted)
    return (node.is_object | node.is_array) & (F.to_json(node.v) == F.lit(_canon(value)))


# ---------------------------------------------------------------------------
# Compiler
# ---------------------------------------------------------------------------

class _Compiler:
    def __init__(self, root: Any, prefix: str = "_pw_n", gate: Column | None = None):
        self.root = root
        self.defs = root.get("definitions", {}) if isinstance(root, dict) else {}
        self._ref_stack: list[str] = []
        # Intermediate columns ("lets") keep each generated method small:
        # every schema node's value and type are computed once, in an earlier
        # projection, instead of being inlined into every keyword's test.
        self.lets: list[tuple[str, Column, int]] = []
        self.prefix = prefix
        self.gate = gate
        self.lambda_depth = 0

    def node(self, v: Column, depth: int = 0) -> _Node:
        """A schema node's value and type as intermediate columns. Values of
        nesting depth d form level 2d, their types level 2d + 1, so all
        columns of one level can be added in one projection."""
        if self.lambda_depth:
            return _Node(v)
        i = len(self.lets)
        vn, tn = f"{self.prefix}{i}", f"{self.prefix}{i + 1}"
        expr = v if self.gate is None else F.when(self.gate, v)
        self.lets.append((vn, expr, 2 * depth))
        self.lets.append((tn, _ty(F.col(vn)), 2 * depth + 1))
        return _Node(F.col(vn), F.col(tn))

    # validation of the document itself (registration-time errors)
    def check(self, s: Any, where: str = "#") -> None:
        if isinstance(s, bool):
            return
        if not isinstance(s, dict):
            raise SchemaCompileError(f"{where}: a schema must be an object or a boolean")
        for k, val in s.items():
            if k in ANNOTATIONS:
                continue
            if k not in _ASSERTIONS:
                raise SchemaCompileError(f"{where}: unsupported keyword '{k}'")
            if k == "type":
                types = val if isinstance(val, list) else [val]
                bad = [t for t in types if t not in _JSON_TYPES]
                if bad or not types:
                    raise SchemaCompileError(f"{where}/type: unknown type {bad}")
            elif k == "required":
                if not isinstance(val, list) or not all(isinstance(x, str) for x in val):
                    raise SchemaCompileError(f"{where}/required: must be a list of strings")
            elif k in ("properties", "patternProperties", "definitions"):
                if not isinstance(val, dict):
                    raise SchemaCompileError(f"{where}/{k}: must be an object")
                for pk, ps in val.items():
                    if k == "patternProperties":
                        _check_regex(pk, f"{where}/{k}")
                    self.check(ps, f"{where}/{k}/{pk}")
            elif k == "enum":
                if not isinstance(val, list) or not val:
                    raise SchemaCompileError(f"{where}/enum: must be a non-empty list")
            elif k in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"):
                if isinstance(val, bool) or not isinstance(val, (int, float)):
                    raise SchemaCompileError(f"{where}/{k}: must be a number")
                if k == "multipleOf" and val <= 0:
                    raise SchemaCompileError(f"{where}/multipleOf: must be > 0")
            elif k in ("minLength", "maxLength", "minItems", "maxItems", "minProperties", "maxProperties"):
                if isinstance(val, bool) or not isinstance(val, int) or val < 0:
                    raise SchemaCompileError(f"{where}/{k}: must be a non-negative integer")
            elif k == "pattern":
                if not isinstance(val, str):
                    raise SchemaCompileError(f"{where}/pattern: must be a string")
                _check_regex(val, where)
            elif k == "items":
                for i, it in enumerate(val if isinstance(val, list) else [val]):
                    self.check(it, f"{where}/items/{i}")
            elif k in ("additionalItems", "additionalProperties", "contains", "propertyNames",
                       "not", "if", "then", "else"):
                self.check(val, f"{where}/{k}")
            elif k in ("allOf", "anyOf", "oneOf"):
                if not isinstance(val, list) or not val:
                    raise SchemaCompileError(f"{where}/{k}: must be a non-empty list")
                for i, it in enumerate(val):
                    self.check(it, f"{where}/{k}/{i}")
            elif k == "dependencies":
                if not isinstance(val, dict):
                    raise SchemaCompileError(f"{where}/dependencies: must be an object")
                for dk, dv in val.items():
                    if not isinstance(dv, list):
                        self.check(dv, f"{where}/dependencies/{dk}")
            elif k == "uniqueItems":
                if not isinstance(val, bool):
                    raise SchemaCompileError(f"{where}/uniqueItems: must be a boolean")
            elif k == "$ref":
                self._resolve(val)

    def _resolve(self, ref: str) -> Any:
        if not isinstance(ref, str) or not ref.startswith("#/definitions/"):
            raise SchemaCompileError(f"unsupported $ref '{ref}' (only local #/definitions/...)")
        name = ref[len("#/definitions/"):]
        if name not in self.defs:
            raise SchemaCompileError(f"$ref '{ref}' not found")
        return self.defs[name]

    # expression building
    def errors(self, s: Any, v: Column, ptr: str, depth: int = 0, node: _Node | None = None) -> Column:
        if s is True or s == {}:
            return _empty()
        if s is False:
            return F.when(v.isNotNull(), F.array(_msg(ptr, "not allowed"))).otherwise(_empty())
        if "$ref" in s:
            ref = s["$ref"]
            if ref in self._ref_stack:
                raise SchemaCompileError(f"recursive $ref '{ref}' is not supported")
            self._ref_stack.append(ref)
            try:
                return self.errors(self._resolve(ref), v, ptr, depth)
            finally:
                self._ref_stack.pop()
        n = node if node is not None else self.node(v, depth)
        n.depth = depth
        parts: list = []
        # type first: a value of the wrong type gets only that error
        type_ok = F.lit(True)
        if "type" in s:
            types = s["type"] if isinstance(s["type"], list) else [s["type"]]
            conds = []
            for t in types:
                conds.append({
                    "object": n.is_object, "array": n.is_array, "string": n.is_string,
                    "number": n.is_number, "integer": n.is_integer, "boolean": n.is_bool,
                    "null": n.is_null}[t])
            type_ok = conds[0]
            for c in conds[1:]:
                type_ok = type_ok | c
            parts.append(_one(~type_ok, ptr, F.concat(
                F.lit("must be " + " or ".join(types) + " (got "), n.type_name(), F.lit(")"))))
        rest = self._keywords(s, n, ptr)
        if rest:
            parts.extend(_gate(rest, type_ok) if "type" in s else rest)
        return _combine(parts)

    def _keywords(self, s: dict, n: _Node, ptr: str) -> list:
        out: list = []
        got_json = n.json_text()
        numeric = ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf")
        types = s.get("type", [])
        types = types if isinstance(types, list) else [types]
        if any(k in s for k in numeric) or "number" in types or "integer" in types:
            # a non-finite number seen by a numeric check: the event counts
            # as invalid JSON (see NOT_JSON_MARK); numeric checks skip it
            out.append(("s", F.when(n.is_inf, F.lit(NOT_JSON_MARK))))
        if "const" in s:
            out.append(_one(~_equals_literal(n, s["const"]), ptr, F.concat(
                F.lit(f"must be {_lit_display(s['const'])} (got "), got_json, F.lit(")"))))
        if "enum" in s:
            ok = F.lit(False)
            for e in s["enum"]:
                ok = ok | _equals_literal(n, e)
            shown = ", ".join(_lit_display(e) for e in s["enum"])
            out.append(_one(~ok, ptr, F.concat(
                F.lit(f"must be one of [{shown}] (got "), got_json, F.lit(")"))))
        got_num = F.concat(F.lit(" (got "), n.number_text(), F.lit(")"))
        for key, op, sym in (("minimum", lambda a, b: a < b, ">="),
                             ("maximum", lambda a, b: a > b, "<="),
                             ("exclusiveMinimum", lambda a, b: a <= b, ">"),
                             ("exclusiveMaximum", lambda a, b: a >= b, "<")):
            if key in s:
                bound = float(s[key])
                out.append(_one(n.is_number & ~n.is_inf & op(n.num, F.lit(bound)), ptr,
                                F.concat(F.lit(f"must be {sym} {_fmt_num(s[key])}"), got_num)))
        if "multipleOf" in s:
            m = F.lit(str(s["multipleOf"])).cast("decimal(38,18)")
            d = F.try_variant_get(n.v, "$", "decimal(38,18)")
            bad = n.is_number & ~n.is_inf & (F.coalesce(F.try_mod(d, m), F.lit(1)) != F.lit(0))
            out.append(_one(bad, ptr, F.concat(
                F.lit(f"must be a multiple of {_fmt_num(s['multipleOf'])}"), got_num)))
        length = F.char_length(n.str)
        if "minLength" in s:
            out.append(_one(n.is_string & (length < s["minLength"]), ptr, F.concat(
                F.lit(f"length must be >= {s['minLength']} (got "), length.cast("string"), F.lit(")"))))
        if "maxLength" in s:
            out.append(_one(n.is_string & (length > s["maxLength"]), ptr, F.concat(
                F.lit(f"length must be <= {s['maxLength']} (got "), length.cast("string"), F.lit(")"))))
        if "pattern" in s:
            out.append(_one(n.is_string & ~F.coalesce(n.str.rlike(s["pattern"]), F.lit(False)), ptr,
                            f"must match pattern {json.dumps(s['pattern'])}"))
        out.extend(self._object_keywords(s, n, ptr))
        out.extend(self._array_keywords(s, n, ptr))
        out.extend(self._combinators(s, n, ptr))
        return out

    def _object_keywords(self, s: dict, n: _Node, ptr: str) -> list:
        out: list = []
        keys = ("required", "properties", "additionalProperties", "patternProperties",
                "propertyNames", "minProperties", "maxProperties", "dependencies")
        if not any(k in s for k in keys):
            return out
        obj = n.is_object
        props = s.get("properties", {})
        # a property with a schema of its own gets its value as an
        # intermediate column once; the required check and the property's
        # own keywords then read that column instead of extracting it again
        children: dict[str, _Node] = {}
        for name, sub in props.items():
            if isinstance(sub, dict) and sub and "$ref" not in sub and not self.lambda_depth:
                children[name] = self.node(_child(n.v, name), n.depth + 1)
        for name in s.get("required", []):
            value = children[name].v if name in children else _child(n.v, name)
            out.append(_one(obj & value.isNull(), ptr, f"missing required property '{name}'"))
        for name, sub in props.items():
            cn = children.get(name)
            cv = cn.v if cn is not None else _child(n.v, name)
            errs = self.errors(sub, cv, _ptr(ptr, name), n.depth + 1, node=cn)
            out.append(_arr(F.when(obj & cv.isNotNull(), errs).otherwise(_empty())))
        as_map = F.try_variant_get(n.v, "$", "map<string,variant>")
        mkeys = F.map_keys(as_map)
        nkeys = F.size(mkeys)
        if "minProperties" in s:
            out.append(_one(obj & (nkeys < s["minProperties"]), ptr, F.concat(
                F.lit(f"must have at least {s['minProperties']} properties (got "),
                nkeys.cast("string"), F.lit(")"))))
        if "maxProperties" in s:
            out.append(_one(obj & (nkeys > s["maxProperties"]), ptr, F.concat(
                F.lit(f"must have at most {s['maxProperties']} properties (got "),
                nkeys.cast("string"), F.lit(")"))))
        pprops = s.get("patternProperties", {})
        if "additionalProperties" in s:
            ap = s["additionalProperties"]

            def is_extra(k: Column) -> Column:
                cond = ~k.isin(list(props.keys())) if props else F.lit(True)
                for pat in pprops:
                    cond = cond & ~k.rlike(pat)
                return cond
            extra = F.array_sort(F.filter(mkeys, is_extra))
            if ap is False:
                out.append(_one(obj & (F.size(extra) > 0), ptr, F.concat(
                    F.lit("additional properties not allowed: "),
                    F.array_join(F.transform(extra, lambda k: F.concat(F.lit("'"), k, F.lit("'"))), ", "))))
            elif isinstance(ap, dict) and ap:
                out.append(_arr(self._each_entry(ap, as_map, extra, obj, ptr)))
        for pat, sub in pprops.items():
            matching = F.array_sort(F.filter(mkeys, _matches(pat)))
            out.append(_arr(self._each_entry(sub, as_map, matching, obj, ptr)))
        if "propertyNames" in s:
            sub = s["propertyNames"]
            self.lambda_depth += 1
            try:
                bad = F.filter(mkeys, lambda k: F.size(
                    self.errors(sub, _string_variant(k), ptr)) > 0)
            finally:
                self.lambda_depth -= 1
            out.append(_one(obj & (F.size(bad) > 0), ptr, F.concat(
                F.lit("invalid property names: "), F.array_join(F.array_sort(bad), ", "))))
        for dk, dv in s.get("dependencies", {}).items():
            present = obj & _child(n.v, dk).isNotNull()
            if isinstance(dv, list):
                for need in dv:
                    out.append(_one(present & _child(n.v, need).isNull(), ptr,
                                    f"property '{need}' is required by '{dk}'"))
            else:
                out.append(_arr(F.when(present, self.errors(dv, n.v, ptr, n.depth)).otherwise(_empty())))
        return out

    def _each_entry(self, sub: Any, as_map: Column, keys: Column, gate: Column, ptr: str) -> Column:
        self.lambda_depth += 1
        try:
            per_key = F.transform(keys, lambda k: self._errors_dynamic(sub, F.element_at(as_map, k), ptr, k))
        finally:
            self.lambda_depth -= 1
        return F.when(gate, F.flatten(per_key)).otherwise(_empty())

    def _errors_dynamic(self, sub: Any, v: Column, ptr: str, token: Column) -> Column:
        """Errors for a child whose name is only known at run time."""
        marker = "\u0000PTR\u0000"
        errs = self.errors(sub, v, marker)
        child_ptr = F.concat(F.lit("" if ptr == ROOT_POINTER else ptr), F.lit("/"),
                             F.replace(F.replace(token, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))
        return F.transform(errs, lambda e: F.replace(e, F.lit(marker), child_ptr))

    def _array_keywords(self, s: dict, n: _Node, ptr: str) -> list:
        out: list = []
        keys = ("items", "additionalItems", "minItems", "maxItems", "uniqueItems", "contains")
        if not any(k in s for k in keys):
            return out
        arr = n.is_array
        elems = F.try_variant_get(n.v, "$", "array<variant>")
        size = F.size(elems)
        if "minItems" in s:
            out.append(_one(arr & (size < s["minItems"]), ptr, F.concat(
                F.lit(f"must have at least {s['minItems']} items (got "), size.cast("string"), F.lit(")"))))
        if "maxItems" in s:
            out.append(_one(arr & (size > s["maxItems"]), ptr, F.concat(
                F.lit(f"must have at most {s['maxItems']} items (got "), size.cast("string"), F.lit(")"))))
        if s.get("uniqueItems") is True:
            canon = F.transform(elems, lambda e: F.to_json(e))
            out.append(_one(arr & (F.size(F.array_distinct(canon)) < size), ptr, "items must be unique"))
        self.lambda_depth += 1
        try:
            self._items(s, n, ptr, out, arr, elems, size)
        finally:
            self.lambda_depth -= 1
        return out

    def _items(self, s: dict, n: _Node, ptr: str, out: list, arr: Column, elems: Column,
               size: Column) -> None:
        items = s.get("items")
        if isinstance(items, dict) or isinstance(items, bool):
            per = F.transform(elems, lambda e, i: self._errors_dynamic(items, e, ptr, i.cast("string")))
            out.append(_arr(F.when(arr, F.flatten(per)).otherwise(_empty())))
        elif isinstance(items, list):
            for i, sub in enumerate(items):
                e = F.try_element_at(elems, F.lit(i + 1))
                out.append(_arr(F.when(arr & (size > i), self.errors(sub, e, _ptr(ptr, str(i))))
                                .otherwise(_empty())))
            ai = s.get("additionalItems")
            if ai is False:
                out.append(_one(arr & (size > len(items)), ptr, F.concat(
                    F.lit(f"must have at most {len(items)} items (got "), size.cast("string"), F.lit(")"))))
            elif isinstance(ai, dict) and ai:
                k0 = len(items)
                per = F.transform(elems, lambda e, i: F.when(
                    i >= k0, self._errors_dynamic(ai, e, ptr, i.cast("string")))
                    .otherwise(_empty()))
                out.append(_arr(F.when(arr, F.flatten(per)).otherwise(_empty())))
        if "contains" in s:
            sub = s["contains"]
            any_ok = F.exists(elems, lambda e: F.size(self.errors(sub, e, ptr)) == 0)
            out.append(_one(arr & ~F.coalesce(any_ok, F.lit(False)), ptr,
                            "must contain at least one matching item"))

    def _combinators(self, s: dict, n: _Node, ptr: str) -> list:
        out: list = []
        if "allOf" in s:
            for sub in s["allOf"]:
                out.append(_arr(self.errors(sub, n.v, ptr, n.depth)))
        if "anyOf" in s:
            subs = [self.errors(sub, n.v, ptr, n.depth) for sub in s["anyOf"]]
            ok = F.lit(False)
            for e in subs:
                ok = ok | (F.size(e) == 0)
            out.append(_arr(F.when(ok, _empty()).otherwise(
                F.concat(F.array(_msg(ptr, "must match at least one schema in anyOf")), *subs))))
        if "oneOf" in s:
            subs = [self.errors(sub, n.v, ptr, n.depth) for sub in s["oneOf"]]
            count = F.lit(0)
            for e in subs:
                count = count + (F.size(e) == 0).cast("int")
            out.append(_arr(F.when(count == 1, _empty())
                            .when(count == 0, F.concat(F.array(_msg(ptr, "must match exactly one schema in oneOf (got 0)")), *subs))
                            .otherwise(F.array(F.concat(F.lit(f"{ptr}: must match exactly one schema in oneOf (got "),
                                                        count.cast("string"), F.lit(")"))))))
        if "not" in s:
            e = self.errors(s["not"], n.v, ptr, n.depth)
            out.append(_one(F.size(e) == 0, ptr, "must not match the schema in not"))
        if "if" in s and ("then" in s or "else" in s):
            cond_ok = F.size(self.errors(s["if"], n.v, ptr, n.depth)) == 0
            then_e = self.errors(s.get("then", True), n.v, ptr, n.depth)
            else_e = self.errors(s.get("else", True), n.v, ptr, n.depth)
            out.append(_arr(F.when(cond_ok, then_e).otherwise(else_e)))
        return out


def _matches(pattern: str):
    """A one-argument predicate for ``F.filter`` (a two-argument lambda
    would be called with the element index)."""
    return lambda k: k.rlike(pattern)


#: Patterns that ``parse_without_java`` has met.
_later: list[str] | None = None


def parse_without_java(text: Any) -> list[str]:
    """Checks a schema where there is no Java at hand (in a task): its patterns, not checked yet."""
    global _later
    _later = []
    try:
        parse_schema(text)
        return sorted(set(_later))
    finally:
        _later = None


def _check_regex(p: str, where: str) -> None:
    """Patterns run as Java's, so Java says whether they compile (or the caller asks it later)."""
    if _later is not None:
        _later.append(p)
        return
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise SchemaCompileError(f"{where}: patterns are checked by a running session")
    try:
        spark._jvm.java.util.regex.Pattern.compile(p)
    except IllegalArgumentException as exc:
        raise SchemaCompileError(f"{where}: invalid pattern {p!r}: {exc}") from exc


def _refs(s: Any) -> set[str]:
    """Definitions that a schema names."""
    if isinstance(s, dict):
        own = {s["$ref"].rpartition("/")[2]} if isinstance(s.get("$ref"), str) else set()
        return own.union(*(_refs(v) for k, v in s.items() if k not in ("enum", "const", "definitions")), set())
    return set().union(*map(_refs, s)) if isinstance(s, list) else set()


def _check_recursion(defs: dict[str, Any]) -> None:
    """A definition that leads back to itself has no finite expression."""
    left = {name: _refs(body) & defs.keys() for name, body in defs.items()}
    while free := [name for name, to in left.items() if not to]:
        for name in free:
            del left[name]
        left = {name: to - set(free) for name, to in left.items()}
    if left:
        raise SchemaCompileError(f"recursive $ref in definitions {sorted(left)}")


def parse_schema(schema: Any) -> Any:
    """Accept a dict, a bool, or JSON text; reject anything not compilable."""
    if isinstance(schema, str):
        try:
            schema = json.loads(schema)
        except json.JSONDecodeError as exc:
            raise SchemaCompileError(f"schema is not valid JSON: {exc}") from exc
    if not isinstance(schema, (dict, bool)):
        raise SchemaCompileError("a schema must be a JSON object or boolean")
    comp = _Compiler(schema if isinstance(schema, dict) else {})
    comp.check(schema)
    _check_recursion(comp.defs)
    return schema


def compile_errors(schema: Any, v: Column, prefix: str = "_pw_n",
                   gate: Column | None = None) -> tuple[list[tuple[str, Column, int]], Column]:
    """Compile ``schema`` against ``v`` (a VARIANT column).

    Returns ``(lets, errors)``: intermediate columns ``(name, expr, level)``
    to add first, level by level (``gate`` limits them to the rows the
    schema applies to), and the ARRAY<STRING> of error messages over them.
    """
    schema = parse_schema(schema)
    comp = _Compiler(schema if isinstance(schema, dict) else {}, prefix, gate)
    errs = comp.errors(schema, v, ROOT_POINTER)
    return comp.lets, errs


def errors_column(df, schema: Any, v: Column, out: str = "errors"):
    """Convenience: add the error array of ``v`` against ``schema`` as ``out``."""
    lets, errs = compile_errors(schema, v)
    df = add_lets(df, lets)
    return df.withColumn(out, finalize(errs)).drop(*[n for n, _, _ in lets])


def add_lets(df, lets: list[tuple[str, Column, int]]):
    """Add intermediate columns with one projection per level."""
    for level in sorted({lv for _, _, lv in lets}):
        df = df.withColumns({n: e for n, e, lv in lets if lv == level})
    return df


def strict_parse(payload: Column, token: str | None = None) -> Column:
    """Parse JSON text into a VARIANT, NULL unless the *whole* text is one value.

    ``try_parse_json`` ignores trailing text (``{"a":1} x`` parses). Wrapping
    the payload as ``[payload,"<token>"]`` and requiring exactly two elements
    with the token last rejects that, because the token is drawn per plan
    and cannot occur in the payload.
    """
    token = token or ("pw" + uuid.uuid4().hex)
    return strict_unwrap(wrap_for_parse(payload, token), token)


def wrap_for_parse(payload: Column, token: str) -> Column:
    """First half of ``strict_parse``: parse ``[payload,"<token>"]``."""
    return F.try_parse_json(F.concat(F.lit("["), payload, F.lit(',"%s"]' % token)))


def strict_unwrap(wrapped: Column, token: str) -> Column:
    """Second half of ``strict_parse``: accept only ``[value, token]``."""
    ok = ((F.try_variant_get(wrapped, "$[1]", "string") == F.lit(token))
          & F.variant_get(wrapped, "$[2]", "variant").isNull())
    return F.when(ok, F.variant_get(wrapped, "$[0]", "variant"))
