x781