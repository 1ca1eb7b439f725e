from rivulet.streaming.runs import changes_of, events_stream, finished, interval_join, latest_by_key, live, window_totals

__all__ = ["changes_of", "events_stream", "finished", "interval_join", "latest_by_key", "live", "window_totals"]
