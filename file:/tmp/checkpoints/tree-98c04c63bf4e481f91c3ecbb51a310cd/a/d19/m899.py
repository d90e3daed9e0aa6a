x899