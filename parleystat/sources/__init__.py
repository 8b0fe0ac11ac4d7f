"""Reading surveys, utterances, article corpora and turn logs; writing logs, exports and results."""
