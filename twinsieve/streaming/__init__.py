from twinsieve.streaming.digest_log import digest_resumed, digest_slices, list_pending, logged_digests
from twinsieve.streaming.first_seen import first_seen, save_stream
from twinsieve.streaming.keyed_links import start_keyed_link_stream
from twinsieve.streaming.link_stream import planned_links, saved_arrivals, start_link_stream

__all__ = [
    "digest_resumed",
    "digest_slices",
    "first_seen",
    "list_pending",
    "logged_digests",
    "planned_links",
    "save_stream",
    "saved_arrivals",
    "start_keyed_link_stream",
    "start_link_stream",
]
