"""Tables as price series: where the other operators read from, and stores that they write to."""
