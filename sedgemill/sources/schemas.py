"""Schemas of the store's tables. They are given, never inferred: optional columns would vanish in small samples."""

TABLES = {
    "manifest": "id string, path string, type string, title string, date string, at string, summary string, topics array<string>, entities array<string>, attrs array<string>, tags array<string>",
    "facts": "date string, dated boolean, fact string, kind string, entities array<string>, terms array<string>, src string",
    "events": "date string, cat string, what string, src string",
    "profile": "date string, preferences array<string>, inferred array<string>, src string",
    "modules": "module string, path string, lang string, summary string, symbols array<string>, imports array<string>, loc int",
    "symbols": "name string, kind string, module string, line int, sig string, brief string",
    "edges": "src string, dst string, type string, confidence string",
    "transcript": "type string, cwd string, sessionId string, timestamp string, message string",
}
