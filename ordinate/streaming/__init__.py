"""Event-time streaming: none is offered. What is called "stream" elsewhere in
this library is work pipelined over rows that arrive in sort order."""
