x418