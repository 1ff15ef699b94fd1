"""Ready-made sessions."""

from .ready import PLANS, SessionRegistry, chat_session, document_session, make_session, retrieve, tool_session

__all__ = ["PLANS", "SessionRegistry", "chat_session", "document_session", "make_session", "retrieve", "tool_session"]
