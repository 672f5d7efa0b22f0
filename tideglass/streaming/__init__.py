"""The closed loop: shard state machines, bounded replay, epochs and stateful streams."""
