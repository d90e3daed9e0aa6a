x673