x317