x608