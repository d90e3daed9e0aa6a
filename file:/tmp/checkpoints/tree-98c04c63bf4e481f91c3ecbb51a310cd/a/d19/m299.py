x299