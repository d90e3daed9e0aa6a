x256