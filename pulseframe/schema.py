"""Column layouts of the recording model. Times are microseconds from the recording's start unless named otherwise."""

from __future__ import annotations

#: The series key: every fact row belongs to one channel of one session of one recording.
K = ["recording_id", "session_id", "channel_id"]

RECORDINGS = "recording_id string, name string, path string, utc_start_s bigint, recorder_info map<string,string>, file_damaged boolean"
SESSIONS = "recording_id string, session_id int, start_us bigint, end_us bigint, first_us bigint, last_us bigint, utc_start_s bigint"
SENSORS = "recording_id string, sensor_id int, name string, trace string, bw_limit_id int"
CHANNELS = "recording_id string, session_id int, channel_id string, sensor_id int, name string, format string, n_sub int, sample_bytes int, sample_rate double, tick_scale double, tick_modulus bigint, transform_id int, single_sample boolean, allow_mean_removal boolean"
SUBCHANNELS = "recording_id string, channel_id string, subchannel_id int, name string, axis string, label string, unit string, display_name string, transform_id int, lo double, hi double, sensor_id int, warning_id int, color string, visibility int"
TRANSFORMS = "recording_id string, transform_id int, kind string, c array<double>, x_ref double, y_ref double, y_channel_id string, y_subchannel_id int"
WARNING_RANGES = "recording_id string, warning_id int, channel_id string, subchannel_id int, low double, high double"
ATTRIBUTES = "recording_id string, owner string, name string, ord int, kind string, v_int bigint, v_double double, v_string string, v_binary binary, v_ts timestamp"
RAW_BLOCKS = "recording_id string, session_id int, channel_id string, block_seq bigint, start_tick bigint, end_tick bigint, payload binary, stored_mmm binary"
BLOCKS = "recording_id string, session_id int, channel_id string, block_seq bigint, start_us bigint, end_us bigint, n bigint, idx0 bigint, idx1 bigint, mn array<double>, av array<double>, mx array<double>"
SAMPLES = "recording_id string, session_id int, channel_id string, block_seq bigint, idx bigint, t_us double, raw array<double>"
