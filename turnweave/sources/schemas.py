"""Schemas of the tables, never inferred."""

from __future__ import annotations

WORDS = "array<struct<word: string, start: double, end: double, score: double, speaker: string>>"
CHARS = "array<struct<char: string, start: double, end: double, score: double>>"
SEGMENT = f"start double, end double, text string, avg_logprob double, speaker string, words {WORDS}, chars {CHARS}"
TRANSCRIPT = f"language string, segments array<struct<{', '.join(f.replace(' ', ': ', 1) for f in ('start double', 'end double', 'text string', 'avg_logprob double', 'speaker string'))}, words: {WORDS}, chars: {CHARS}>>"
SESSIONS = "id string, filename string, audio_filename string, status string, stage string, error string, options string, language string, diarized int, model string, num_segments int, duration double, translations string, created_at string, updated_at string"
SETTINGS = "key string, value string"
SPEAKER_NAMES = "session_id string, speaker_key string, name string"
OVERLAY = "version int, target_language string, service string, created_at string, entries map<string, struct<src: string, tr: string>>"
MANIFEST = "version int, generation int, created_at string, entries map<string, struct<hash: string, size: bigint, mtime: double>>"
