x872