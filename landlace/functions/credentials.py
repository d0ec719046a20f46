"""Passwords and signed tokens, as plain functions."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import os
import time

ROUNDS, HOURS = 200_000, 8


def hashed(password: str, salt: bytes | None = None, rounds: int = ROUNDS) -> str:
    salt = os.urandom(16) if salt is None else salt
    return "$".join(("pbkdf2_sha256", str(rounds), salt.hex(), hashlib.pbkdf2_hmac("sha256", password.encode(), salt, rounds).hex()))


def matches(password: str, stored: str) -> bool:
    """Whether the password is the stored one; a malformed entry matches none."""
    parts = (stored or "").split("$")
    if len(parts) != 4 or not parts[1].isdigit():
        return False
    try:
        return hmac.compare_digest(hashed(password, bytes.fromhex(parts[2]), int(parts[1])), stored)
    except ValueError:
        return False


def _signature(payload: str, secret: bytes) -> str:
    return hmac.new(secret, payload.encode(), hashlib.sha256).hexdigest()


def token(user: str, secret: bytes, now: float | None = None) -> str:
    body = json.dumps({"user": user, "until": int((time.time() if now is None else now) + HOURS * 3600)})
    payload = base64.urlsafe_b64encode(body.encode()).decode()
    return f"{payload}.{_signature(payload, secret)}"


def user_of(text: str, secret: bytes, now: float | None = None) -> str | None:
    """The user of a genuine token that hasn't run out."""
    payload, _, signature = (text or "").rpartition(".")
    if not payload or not hmac.compare_digest(signature, _signature(payload, secret)):
        return None
    body = json.loads(base64.urlsafe_b64decode(payload))
    return body["user"] if body["until"] > (time.time() if now is None else now) else None
