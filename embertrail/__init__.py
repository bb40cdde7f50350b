"""Job-log forensics for fleets of Spark applications, as DataFrame operators."""
